"""Removal of word passages that a document with a smaller id has too.

A passage is `window` consecutive words. A word goes if a passage that covers it also starts in a document with a smaller
doc_id; passages are judged on the input. The work is exact and has bounded pieces:

1. Texts are packed in blocks of about 4 MB, written once.
2. Each passage belongs to its anchor, the least hash of its runs of `seed` words. Blocks send each anchor that they hold
   once, as one row with the number of documents, and get those of two or more documents back.
3. For those, blocks send their different runs of passages with one anchor, one row for each with the least and greatest doc_id, to
   the anchor's shard. An anchor of very many documents sends single passages, which are dealt by their own hash: so a passage
   that a third of all documents share takes one row from a block and no shard takes more than its share.
4. A shard builds an FM-index of its runs, streams the runs through it, and gives each passage's least doc_id back.
5. Blocks mark the words and join what is left.

Null texts have no words. A null doc_id counts as greater than all others. Rows with one doc_id do not remove one another.
Ties, repeated rows, empty tables and further columns are fine; the result has a row for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.fmindex import FMIndex
from samewise.llm.words import Words, in_blocks, mix, packed, record_batch, run_hashes, unpacked
from samewise.session import written

WINDOW = 13
SEED = 5
#: Anchors of more documents than this send single passages.
FREQUENT = 2000
#: Most passages in a run.
RUN = 32
SHARD_BYTES = 12 << 20
#: Text of a block, and of what a shuffle's task gets at most.
BLOCK_BYTES = 4 << 20
TASK_BYTES = 256 << 20
NO_ID = 2**63 - 1


def anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all passages and the anchor of each."""
    places = np.flatnonzero(words.whole(window))
    least = words.shingles(seed)
    span, reach = 1, window - seed + 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    return places, least[places]


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].cast(pa.int64()).fill_null(NO_ID).to_numpy().astype(np.int64)


def _heads(words: Words, places: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where passages of one text that follow one another with one anchor begin, and how many they are."""
    new = np.ones(len(places), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (places[1:] != places[:-1] + 1)  # texts do not join: passages that cross are not in places
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(places)))


def _counts(words: Words, places: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different anchors and how many texts have each."""
    first, _ = _heads(words, places, anchor)
    a, t = anchor[first], words.texts[places[first]]
    order = np.argsort(a, kind="stable")  # texts stay in order
    a, t = a[order], t[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    a = a[new]
    at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    return a[at], np.diff(np.append(at, len(a)))


def _candidates(words: Words, known: pa.Table, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of passages whose anchor is known: first place, number of passages, content hash, and the hash that deals them."""
    places, anchor = anchors(words, window, seed)
    first, size = _heads(words, places, anchor)
    values = known["a"].to_numpy()
    order = np.argsort(values)
    values, many = values[order], known["many"].to_numpy(zero_copy_only=False)[order]
    own = anchor[first]
    at = np.minimum(np.searchsorted(values, own), max(0, len(values) - 1))
    hit = values[at] == own if len(values) else np.zeros(len(own), bool)
    first, size, own, frequent = places[first[hit]], size[hit], own[hit], many[at[hit]]
    most = np.where(frequent, 1, RUN)
    parts = -(-size // most)
    row = np.repeat(np.arange(len(first)), parts)
    back = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * most[row]
    start, size = first[row] + back, np.minimum(most[row], size[row] - back)
    content = run_hashes(words.hashes, start, start + size + window - 1)
    return start, size, content, np.where(frequent[row], content, own[row])


def send_anchors(window: int, seed: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                words = Words(unpacked(blob.as_py())["text"])
                values, counts = _counts(words, *anchors(words, window, seed))
                yield record_batch(["key", "block", "n"], [values.view(np.int64), np.full(len(values), block), counts.astype(np.int64)])

    return send


RUNS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("run", pa.binary()), ("least", pa.int64()), ("most", pa.int64())])


def _known(rows: pa.Table) -> pa.Table:
    """Anchors with whether very many documents have them."""
    return pa.table({"a": rows["key"].to_numpy().view(np.uint64), "many": rows["many"]})


def send_runs(shards: int, window: int, seed: int):
    def send(key, blocks: pa.Table, known: pa.Table) -> pa.Table:
        if not blocks.num_rows or not known.num_rows:
            return RUNS.empty_table()
        table = unpacked(blocks["blob"][0].as_py())
        words, ids = Words(table["text"]), _ids(table)
        start, size, content, dealt = _candidates(words, _known(known), window, seed)
        _, which, inverse = np.unique(content, return_index=True, return_inverse=True)
        own = ids[words.texts[start]]
        least, most = np.full(len(which), NO_ID), np.full(len(which), -(2**63))
        np.minimum.at(least, inverse, own)
        np.maximum.at(most, inverse, own)
        raw = words.raw.tobytes()
        texts = [raw[a:b] for a, b in zip(words.starts[start[which]].tolist(), words.ends[start[which] + size[which] + window - 2].tolist(), strict=True)]
        shard = (mix(dealt[which], 3) % np.uint64(shards)).astype(np.int64)
        return pa.table([shard, np.full(len(which), blocks["block"][0].as_py()), pa.array(texts, pa.binary()), least, most], schema=RUNS)

    return send


ANSWERS = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("least", pa.list_(pa.int64()))])


def match_runs(window: int):
    """A shard: all runs in an FM-index, all runs streamed through it; each passage's least doc_id, for the blocks that need it."""

    def match(runs: pa.Table) -> pa.Table:
        words = Words(runs["run"].cast(pa.large_string()))
        start, end = words.firsts[:-1], words.firsts[1:]
        content = run_hashes(words.hashes, start, end)
        _, which, inverse = np.unique(content, return_index=True, return_inverse=True)
        least = np.full(len(which), NO_ID)
        np.minimum.at(least, inverse, runs["least"].to_numpy())
        vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        start, end = start[which], end[which]
        length = end - start
        at = np.cumsum(length + 1) - length  # a separator before each
        text = np.zeros(int(length.sum() + len(length)) + 1, np.int64)
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        text[np.repeat(at, length) + inner] = symbols[np.repeat(start, length) + inner] + 1
        of = np.full(len(text), NO_ID)
        of[np.repeat(at, length) + inner] = np.repeat(least, length)
        index = FMIndex(text, len(vocabulary) + 1, window, of)
        run, place, group = index.windows(text, at, at + length)
        passages = length - window + 1
        base = np.cumsum(passages) - passages
        answer = np.full(int(passages.sum()), NO_ID)
        answer[base[run] + place - at[run]] = index.least[group]
        lowest = np.minimum.reduceat(answer, base)
        need = np.flatnonzero(lowest[inverse] < runs["most"].to_numpy())
        k = inverse[need]
        flat = np.repeat(base[k], passages[k]) + np.arange(int(passages[k].sum())) - np.repeat(np.cumsum(passages[k]) - passages[k], passages[k])
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(passages[k])).astype(np.int32), pa.array(answer[flat]))
        return pa.table([runs["block"].to_numpy()[need], content[which[k]].view(np.int64), lists], schema=ANSWERS)

    return match


def mark(words: Words, ids: np.ndarray, answer: pa.Table, known: pa.Table, window: int, seed: int) -> np.ndarray:
    """Which words go."""
    cover = np.zeros(len(words) + 1, np.int64)
    if answer.num_rows and known.num_rows:
        content = answer["key"].to_numpy().view(np.uint64)
        order = np.argsort(content)
        lists = answer["least"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        start, size, own, _ = _candidates(words, _known(known), window, seed)
        at = np.minimum(np.searchsorted(content[order], own), len(order) - 1)
        hit = content[order][at] == own
        start, size, row = start[hit], size[hit], order[at[hit]]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(start, size) + inner
        less = values[np.repeat(offsets[row], size) + inner] < ids[words.texts[place]]
        np.add.at(cover, place[less], 1)
        np.subtract.at(cover, place[less] + window, 1)
    return np.cumsum(cover[:-1]) > 0


def kept_texts(words: Words, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Words, words that go, and the others joined by one space, for each text."""
    n_gone = np.append(0, np.cumsum(gone))
    # all kept words and one space after each, in one buffer
    keep = ~gone
    length = (words.ends - words.starts)[keep]
    begin = words.starts[keep]
    size = length + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    to = np.cumsum(size) - size
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + inner] = words.raw[np.repeat(begin, length) + inner]
    data = out.tobytes()
    ends = np.append(0, np.cumsum(size))
    firsts = words.firsts
    before = firsts - n_gone[firsts]  # kept words before each text
    for t in range(len(firsts) - 1):
        a, b = ends[before[t]], ends[before[t + 1]]
        yield int(firsts[t + 1] - firsts[t]), int(n_gone[firsts[t + 1]] - n_gone[firsts[t]]), data[a : b - 1] if b > a else b""


def finish(window: int, seed: int, schema: pa.Schema, digest: bool):
    def work(key, blocks, told):
        if not blocks.num_rows:
            return schema.empty_table()
        table = unpacked(blocks["blob"][0].as_py())
        words, ids = Words(table["text"]), _ids(table)
        answer = pc.is_valid(told["least"])
        gone = mark(words, ids, told.filter(answer), told.filter(pc.invert(answer)), window, seed)
        rows = list(kept_texts(words, gone))
        found = {"n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64())}
        if digest:
            found["kept_sha256"] = pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())
        else:
            found["text"] = pa.array([t if not r[1] else r[2].decode() for r, t in zip(rows, table["text"].to_pylist(), strict=True)], pa.string())
        return pa.table([found[n] if n in found else table[n] for n in schema.names], schema=schema)

    return work


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, digest: bool = False, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, further columns) with repeated passages removed from text, and n_words and n_removed.

    A text that loses nothing stays as it is; else its kept words are joined by one space. With digest, kept_sha256 (of
    all texts' kept words, so joined) stands in place of the text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = written(in_blocks(docs, block_bytes), "substring-blocks", codec="none")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(16, -(-total // shard_bytes))

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        """Over more partitions than the session has, if the corpus needs them."""
        parts = -(-total // TASK_BYTES)
        return df.repartition(parts, *keys) if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df

    sent = dealt(blocks.mapInArrow(send_anchors(window, seed), "key long, block long, n long"), "key")
    known = sent.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total > 1")
    known = written(known.select("block", "key", (F.col("total") > FREQUENT).alias("many")), "substring-anchors")
    own = dealt(blocks.select("block", "blob"), "block").groupBy("block")  # both uses below share one exchange
    runs = own.cogroup(known.groupBy("block")).applyInArrow(send_runs(shards, window, seed), "shard long, block long, run binary, least long, most long")
    answers = dealt(runs, "shard").groupBy("shard").applyInArrow(match_runs(window), "block long, key long, least array<long>")
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept_sha256") and not (digest and f.name == "text")]
    schema = docs.select(*[F.col(f"`{f.name}`") for f in kept]).schema.add("n_words", "long").add("n_removed", "long")
    if digest:
        schema = schema.add("kept_sha256", "string")
    told = known.withColumn("least", F.lit(None).cast("array<long>")).unionByName(answers.withColumn("many", F.lit(None).cast("boolean")))
    return own.cogroup(told.groupBy("block")).applyInArrow(finish(window, seed, to_arrow_schema(schema), digest), schema)
