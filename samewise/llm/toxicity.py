"""Toxicity by maximum-scoring segments.

A token's score is its log-odds of standing in a toxic document, less an offset that makes ordinary text score below zero.
Odds have Dirichlet priors: a beginning (first letters) is drawn to the share of toxic documents, a word to its beginning,
so inflected and unseen forms of known stems count. Words and beginnings are counted in tables of a fixed number of slots, by
their hash: all of them count, and the tables' size is the same for any corpus (words of one slot share their odds). One linear scan finds all maximal scoring segments of a text; the extreme-value law
of the greatest segment of ordinary text turns their scores, at the text's length, into significance, and a logistic curve over the
most significant segment and the sum of the significant ones gives the score. Labels only come from the training documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from samewise.llm.words import KERNEL_BYTES, Words, record_batch, slices, word_hashes
from samewise.session import drop_written, written

#: Labelled documents, at most, that the model is fitted on.
TRAIN_DOCS = 20_000
#: Slots of the tables of words and of beginnings.
WORD_SLOTS, START_SLOTS = 1 << 21, 1 << 19
BEGINNING = 5
PRIOR = 20.0
OFFSET = 1.5
EULER = 0.5772156649015329


@dataclass
class Tokens:
    """Scores by slot of words, then of beginnings (nan: none seen), for all others `other`."""

    words: np.ndarray
    starts: np.ndarray
    other: float

    def __call__(self, words: Words) -> np.ndarray:
        word, start = slots(words)
        out = np.where(np.isnan(self.words[word]), self.starts[start], self.words[word]).astype(np.float64)
        return np.where(np.isnan(out), self.other, out)


def slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word and of its beginning."""
    begin = word_hashes(words.raw, words.starts, np.minimum(words.ends, words.starts + BEGINNING))
    return (words.hashes % np.uint64(WORD_SLOTS)).astype(np.int64), (begin % np.uint64(START_SLOTS)).astype(np.int64)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) in linear time: each candidate joins those before it that it improves.

    Each candidate knows the last one before it with a smaller sum on its left, so those in between are never looked at again.
    """
    total = 0.0
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to the end, the candidate that it knows
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        j = len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < total:
            start, _, left, _, known = found[j]
            del found[j:]
            j = known
        found.append((start, i + 1, left, total, j))
    return [(a, b, r - l) for a, b, l, r, _ in found]


def text_segments(words: Words, scores: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(words, segments) of each text. Tokens below zero between two others count as one step."""
    positive = np.flatnonzero(scores > 0)
    sums = np.append(0.0, np.cumsum(scores))
    cuts = np.searchsorted(positive, words.firsts)
    for t in range(len(words.firsts) - 1):
        n = int(words.firsts[t + 1] - words.firsts[t])
        at = positive[cuts[t] : cuts[t + 1]]
        if not len(at):
            yield n, []
            continue
        steps = np.empty(2 * len(at) - 1)
        steps[0::2] = scores[at]
        steps[1::2] = sums[at[1:]] - sums[at[:-1] + 1]
        steps[1::2] = np.minimum(steps[1::2], 0.0)
        yield n, [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, s) for a, b, s in maximal_segments(steps.tolist())]


@dataclass
class Calibration:
    rate: float  # of the extreme-value law
    log_k: float
    weights: tuple[float, float, float]

    def statistics(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """The most significant segment and the sum of all, as -ln of the number of such segments expected by chance."""
        excess = [self.rate * s - self.log_k - math.log(max(n, 1)) for _, _, s in segments]
        return max([0.0, *excess]), sum(x for x in excess if x > 0)

    def score(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        a, b = self.statistics(n, segments)
        z = self.weights[0] + self.weights[1] * min(a, 50.0) + self.weights[2] * min(b, 200.0)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@dataclass
class ToxicityModel:
    tokens: Tokens
    calibration: Calibration

    def spans(self, column) -> list[list[tuple[int, int, float]]]:
        """Byte spans of each text's significant passages, with their significance."""
        words = Words(column, plain=True)
        out = []
        for t, (n, segments) in enumerate(text_segments(words, self.tokens(words))):
            base, c = words.bounds[t], self.calibration
            out.append([(int(words.starts[a] - base), int(words.ends[b - 1] - base), c.rate * s - c.log_k - math.log(n)) for a, b, s in segments if c.rate * s > c.log_k + math.log(n)])
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and other documents that hold a word of each slot (with the beginning's slot), and a beginning of each slot."""
    for table in slices(batches, most_bytes=KERNEL_BYTES):
        words = Words(table["text"], plain=True)
        toxic = table["toxic"].to_numpy().astype(np.int64)
        word, begin = slots(words)
        for kind, h in ((0, word), (1, begin)):
            order = np.lexsort((words.texts, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (words.texts[order][1:] != words.texts[order][:-1])
            order = order[new]
            values, first, inverse = np.unique(h[order], return_index=True, return_inverse=True)
            n1 = np.bincount(inverse, weights=toxic[words.texts[order]], minlength=len(values)).astype(np.int64)
            n = np.bincount(inverse, minlength=len(values))
            least = np.minimum.reduceat(begin[order], first) if len(first) else first
            yield record_batch(["kind", "slot", "begin", "n1", "n0"], [np.full(len(values), kind, np.int32), values, least, n1, n - n1])


def _greatest(tokens: Tokens):
    """Of each document toxic, its words and the greatest segment (0: none); counts of token scores once for a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, most_bytes=KERNEL_BYTES):
            words = Words(table["text"], plain=True)
            scores = tokens(words)
            rows = [(n, max((s for _, _, s in found), default=0.0)) for n, found in text_segments(words, scores)]
            hist = np.histogram(np.clip(scores, -8, 8), bins=320, range=(-8, 8))[0]
            yield record_batch(["toxic", "n", "best", "hist"], [table["toxic"].combine_chunks(), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([hist.tolist()] + [None] * (len(rows) - 1), pa.list_(pa.int64()))])

    return work


def _statistics(tokens: Tokens, law: Calibration):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, most_bytes=KERNEL_BYTES):
            words = Words(table["text"], plain=True)
            rows = [law.statistics(n, found) for n, found in text_segments(words, tokens(words))]
            yield record_batch(["toxic", "most", "all"], [table["toxic"].combine_chunks(), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64())])

    return work


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * value)) = 1."""
    low, high = 1e-6, 1.0
    grow = lambda r: float((shares * np.exp(np.minimum(r * values, 500))).sum())
    while grow(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 1 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """From docs (doc_id, text) and labels (doc_id, toxic; nulls are left out, of repeated ids the greatest label counts).

    At most train_docs labels, chosen by a hash of doc_id, are learnt from, and of each no more than its counts and three numbers
    come to the driver. Without documents of either label the share of toxic labels, smoothed, is every text's score.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    train = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-train")  # train_docs rows at most are broadcast
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), sum(n for k, n in size.items() if k != 1)
    share = (n1 + 0.5) / (n1 + n0 + 1)
    base = math.log(share / (1 - share))
    seen = [np.full(n, np.nan, np.float32) for n in (WORD_SLOTS, START_SLOTS)]
    if not n1 or not n0:
        drop_written(train)
        return ToxicityModel(Tokens(*seen, -OFFSET), Calibration(1.0, 0.0, (base, 0.0, 0.0)))
    counted = train.mapInArrow(_counts, "kind int, slot long, begin long, n1 long, n0 long").groupBy("kind", "slot").agg(F.min("begin").alias("begin"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    table = counted.select(F.col("kind").cast("byte"), *[F.col(c).cast("int") for c in ("slot", "begin", "n1", "n0")]).toArrow()  # slots at most, of 17 bytes
    words, starts = ({c: table[c].to_numpy()[at] for c in ("slot", "begin", "n1", "n0")} for at in (table["kind"].to_numpy() == k for k in (0, 1)))
    del table
    prior = np.full(START_SLOTS, share)
    prior[starts["slot"]] = (starts["n1"] + PRIOR * share) / (starts["n1"] + starts["n0"] + PRIOR)
    word_share = (words["n1"] + PRIOR * prior[words["begin"]]) / (words["n1"] + words["n0"] + PRIOR)
    for scores, slot, p in zip(seen, (words["slot"], starts["slot"]), (word_share, prior[starts["slot"]]), strict=True):
        scores[slot] = np.log(p / (1 - p)) - base - OFFSET
    del words, starts, prior, word_share, p, slot
    tokens = Tokens(*seen, -OFFSET)
    held = docs.sparkSession.sparkContext.broadcast(tokens)  # WORD_SLOTS + START_SLOTS numbers

    def told(step, *more):
        return lambda batches: step(held.value, *more)(batches)

    rows = train.mapInArrow(told(_greatest), "toxic int, n long, best double, hist array<long>").toPandas()  # train_docs rows at most
    hist = np.sum([h for h in rows["hist"] if h is not None], axis=0)
    rate = _rate(np.linspace(-8, 8, 321)[:-1] + 0.025, hist / max(1, hist.sum()))
    plain = rows[(rows["toxic"] == 0) & (rows["best"] > 0)]
    law = Calibration(rate, float((rate * plain["best"] - np.log(plain["n"])).mean()) - EULER if len(plain) else 0.0, (0.0, 0.0, 0.0))
    rows = train.mapInArrow(told(_statistics, law), "toxic int, most double, all double").toPandas()  # train_docs rows at most
    x = np.minimum(rows[["most", "all"]].to_numpy(), [50.0, 200.0])
    drop_written(train)
    return ToxicityModel(tokens, Calibration(rate, law.log_k, tuple(_logistic(x, (rows["toxic"] == 1).to_numpy().astype(float)))))


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (with text, further columns stay; a column score is replaced) and score, from 0 to 1: a row for each row.

    Null texts count as empty, and a text without words scores as one without toxic passages; only the text enters, so equal texts have
    equal scores. An empty table gives an empty result. A text of any length is scored in linear time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    held = docs.sparkSession.sparkContext.broadcast(model)  # WORD_SLOTS + START_SLOTS numbers
    rest = docs.drop("score")
    schema = StructType([*rest.schema.fields, StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for table in slices(batches, most_bytes=KERNEL_BYTES):
            words = Words(table["text"], plain=True)
            scores = [m.calibration.score(n, s) for n, s in text_segments(words, m.tokens(words))]
            for b in table.append_column("score", pa.array(scores, pa.float64())).select(arrow.names).to_batches():
                yield b

    return rest.mapInArrow(work, schema)
