"""Document quality from heuristic labellers alone.

Several heuristics vote good, bad or nothing on each text. How often each pattern of votes occurs is counted over all
documents; there are at most 3 ** labellers patterns, however many documents. Expectation-maximisation over the patterns
estimates each labeller's accuracy without any gold label. The posterior of a document's pattern then is the target of a
hashed linear scorer over its words and shape, trained on a bounded sample, which scores every document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from samewise.llm.words import KERNEL_BYTES, SPACE, Words, mix, record_batch, slices, word_hashes

#: Bound of the sample that the linear scorer is trained on; documents are chosen by a hash of their text.
TRAIN_DOCS = 10_000
BUCKETS = 1 << 13
EPOCHS = 6
BAD, NONE, GOOD = 0, 1, 2
#: How often a labeller is taken, before the votes are seen, to vote bad on a good document.
FALSE_ALARMS = 0.003
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 256)]] = True
SIGN = np.array([b < 128 and not chr(b).isalnum() and not SPACE[b] for b in range(256)])

#: (measure, bad if below, bad if above, good from, good to); no vote between. Each is a heuristic on its own.
LABELLERS = (
    ("repeated_next", -1, 0.2, 0, 0.06),
    ("distinct", 0.25, 2, 0.4, 1),
    ("noisy_signs", -1, 0.2, 0, 0.04),
    ("upper", -1, 0.4, 0, 0.15),
    ("bars", -1, 0.12, 0, 0.02),
    ("signs", -1, 0.35, 0, 0.12),
    ("letters", 0.35, 2, 0.7, 1),
    ("word_length", 1.5, 14, 3, 11),
    ("sentence_ends", 0.002, 0.5, 0.015, 0.35),
    ("words", 1, 1e12, 20, 1e12),
)


def measures(words: Words) -> np.ndarray:
    """One row of measures, as named in LABELLERS, for each text."""
    n_texts = len(words.firsts) - 1
    n = np.diff(words.firsts).astype(float)
    some = np.maximum(n, 1)
    per_text = lambda flag: np.bincount(words.texts, weights=flag, minlength=n_texts) / some
    h, t = words.hashes, words.texts
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    key = h ^ mix(t.astype(np.uint64), 51)
    new = np.zeros(len(h), bool)
    new[np.unique(key, return_index=True)[1]] = True
    sums = lambda flag: np.append(0, np.cumsum(flag))
    sign, letter, upper = sums(SIGN[words.raw]), sums(LETTER[words.raw]), sums((words.raw >= 65) & (words.raw <= 90))
    bytes_ = np.maximum(1, sums(~SPACE[words.raw])[words.bounds[1:]] - sums(~SPACE[words.raw])[words.bounds[:-1]])
    share = lambda s: (s[words.bounds[1:]] - s[words.bounds[:-1]]) / bytes_
    signs_in = sign[words.ends] - sign[words.starts]
    last = words.raw[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
    solid_sign = SIGN[words.raw]
    latin = np.maximum(1, (sums((words.raw >= 97) & (words.raw <= 122))[words.bounds[1:]] - sums((words.raw >= 97) & (words.raw <= 122))[words.bounds[:-1]]) + (upper[words.bounds[1:]] - upper[words.bounds[:-1]]))
    found = {
        "repeated_next": per_text(again),
        "distinct": np.where(n >= 40, per_text(new), 1.0),
        "noisy_signs": per_text(signs_in >= 2),
        "upper": (upper[words.bounds[1:]] - upper[words.bounds[:-1]]) / latin,
        "bars": per_text((words.ends - words.starts == 1) & (last == 124)),
        "signs": (np.append(0, np.cumsum(solid_sign))[words.bounds[1:]] - np.append(0, np.cumsum(solid_sign))[words.bounds[:-1]]) / bytes_,
        "letters": share(letter),
        "word_length": bytes_ / some,
        "sentence_ends": np.where(n >= 20, per_text((last == 46) | (last == 63) | (last == 33)), 0.1),
        "words": n,
    }
    return np.column_stack([found[name] for name, *_ in LABELLERS])


def votes(values: np.ndarray) -> np.ndarray:
    out = np.full(values.shape, NONE, np.int64)
    for k, (_, below, above, low, high) in enumerate(LABELLERS):
        v = values[:, k]
        out[(v < below) | (v > above), k] = BAD
        out[(v >= low) & (v <= high), k] = GOOD
    return out


POWERS = 3 ** np.arange(len(LABELLERS))


@dataclass
class LabelModel:
    """Classes are good and, for each labeller, bad for its reason: texts are bad for different reasons, and a labeller knows its own.

    shares: of the classes, good first. table: class x labeller x vote, the odds of each vote.
    """

    shares: np.ndarray
    table: np.ndarray

    def classes(self, v: np.ndarray) -> np.ndarray:
        """Probability of each class for documents with these votes."""
        logs = np.log(self.shares)[None, :] + sum(np.log(self.table[:, k, v[:, k]]).T for k in range(v.shape[1]))
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(1, keepdims=True)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        return self.classes(v)[:, 0]

    def accuracies(self) -> np.ndarray:
        """For each labeller, how often it finds its own reason, and how often it votes bad on good documents."""
        k = np.arange(self.table.shape[1])
        return np.column_stack([self.table[1:][k, k, BAD], self.table[0, :, BAD]])


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 200) -> LabelModel:
    """From vote patterns and their counts.

    Priors are Dirichlet: a labeller finds its own reason nine times in ten, with the weight of a twentieth of all
    documents, so that a reason can't come to stand for something else, and it votes bad on a good document three times in
    a thousand, with the weight of half of all documents; other votes have a weak prior.
    """
    k = v.shape[1]
    total = max(float(n.sum()), 1.0)
    prior = np.ones((k + 1, k, 3)) * np.array([0.5, 0.5, 2.0])
    own = np.arange(k)
    prior[1 + own, own] = np.array([0.9, 0.07, 0.03]) * (10 + 0.05 * total)
    begin = prior / prior.sum(2, keepdims=True)
    begin[0] = [FALSE_ALARMS, 0.2, 0.8 - FALSE_ALARMS]
    model = LabelModel(np.append(0.85, np.full(k, 0.15 / k)), begin)
    for _ in range(rounds):
        p = model.classes(v) * n[:, None]
        table = prior.copy()
        for vote in (BAD, NONE, GOOD):
            table[:, :, vote] += p.T @ (v == vote)
        table /= table.sum(2, keepdims=True)
        false_alarms = (p[:, 0] @ (v == BAD) + FALSE_ALARMS * total / 2) / (p[:, 0].sum() + total / 2)
        table[0] *= ((1 - false_alarms) / np.maximum(1e-12, 1 - table[0, :, BAD]))[:, None]
        table[0, :, BAD] = false_alarms
        moved = abs(table - model.table).max()
        model = LabelModel((p.sum(0) + 1) / (p.sum() + k + 1), table)
        if moved < 1e-7:
            break
    return model


def features(words: Words, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: (text, bucket, value). Word beginnings and endings by their share, and the measures in steps."""
    n = np.maximum(1, np.diff(words.firsts))
    begin = word_hashes(words.raw, words.starts, np.minimum(words.ends, words.starts + 3))
    end = word_hashes(words.raw, np.maximum(words.starts, words.ends - 2), words.ends)
    steps = np.floor(np.log2(np.maximum(values, 1e-4)) * 2).astype(np.int64)
    texts = [words.texts, words.texts, np.repeat(np.arange(len(values)), values.shape[1])]
    keys = [mix(begin, 61), mix(end, 62), mix((steps + 1000 * (np.arange(values.shape[1]) + 1)[None, :]).ravel().astype(np.uint64), 63)]
    weights = [1 / np.sqrt(n)[words.texts] / 3, 1 / np.sqrt(n)[words.texts] / 3, np.full(values.size, 1.0)]
    return np.concatenate(texts), (np.concatenate(keys) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(weights)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Score of the linear scorer and posterior of the labellers, for each text."""
        values = measures(words)
        t, k, w = features(words, values)
        z = np.bincount(t, weights=self.weights[k] * w, minlength=len(values)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), self.labels.posterior(votes(values))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in slices(batches, most_bytes=KERNEL_BYTES):
        code, n = np.unique(votes(measures(Words(table["text"]))) @ POWERS, return_counts=True)
        yield record_batch(["pattern", "n"], [code.astype(np.int64), n.astype(np.int64)])


def _examples(labels: LabelModel):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, most_bytes=KERNEL_BYTES):
            words = Words(table["text"])
            values = measures(words)
            t, k, w = features(words, values)
            code, inverse = np.unique(t * BUCKETS + k, return_inverse=True)
            total = np.bincount(inverse, weights=w)
            ends = np.searchsorted(code // BUCKETS, np.arange(len(values) + 1))
            bucket = (code % BUCKETS).astype(np.int32)
            parts = list(zip(ends[:-1], ends[1:], strict=True))
            yield record_batch(["h", "p", "bucket", "value"], [table["h"].combine_chunks(), labels.posterior(votes(values)), pa.array([bucket[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([total[a:b].astype(np.float32).tobytes() for a, b in parts], pa.binary())])

    return work


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Label model over all documents (rows with a text column); linear scorer over at most train_docs different texts, taken in order of their hash."""
    texts = docs.select("text")
    counted = texts.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3 ** labellers rows
    total = sum(r["n"] for r in counted)
    v = np.array([r["pattern"] for r in counted], np.int64).reshape(-1, 1) // POWERS % 3
    labels = expectation_maximisation(v, np.array([r["n"] for r in counted], float))
    if not total:
        return QualityModel(labels, np.zeros(BUCKETS), 0.0)
    share = min(1.0, train_docs * 0.9 / total)
    chosen = texts.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))).dropDuplicates(["h"]).select("text", "h")
    weights, squares, bias, rng = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, np.random.default_rng(5)
    examples = chosen.mapInArrow(_examples(labels), "h long, p double, bucket binary, value binary").toLocalIterator()
    rows = sorted(((r["h"], r["p"], np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["value"], np.float32).astype(float)) for r in itertools.islice(examples, train_docs)), key=lambda r: r[0])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            _, p, k, x = rows[i]
            z = float(weights[k] @ x) + bias
            g = 1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) - p
            step = g * x
            squares[k] += step * step
            weights[k] -= 0.3 * step / np.sqrt(squares[k])
            bias -= 0.02 * g
    return QualityModel(labels, weights, bias)


def quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs (with text; further columns stay, but columns of these names are replaced) and score, label_posterior (both 0 to 1, higher: better) and predicted (score of 0.5 or more).

    A row for each row: equal texts have equal scores, null texts are scored as empty ones. An empty table gives an empty result, and a model
    fitted on an empty table scores every text 0.5.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    rest = docs.drop("score", "label_posterior", "predicted")
    schema = StructType([*rest.schema.fields, StructField("score", DoubleType()), StructField("label_posterior", DoubleType()), StructField("predicted", IntegerType())])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, most_bytes=KERNEL_BYTES):
            score, posterior = held.value.score(Words(table["text"]))
            for name, column in (("score", score), ("label_posterior", posterior), ("predicted", (score >= 0.5).astype(np.int32))):
                table = table.append_column(name, pa.array(column))
            yield from table.select(arrow.names).to_batches()

    return rest.mapInArrow(work, schema)
