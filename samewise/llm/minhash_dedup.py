"""Near duplicates by Jaccard similarity of word shingles, with DartMinHash signatures and banded joining.

Darts are thrown at the quarter plane of (weight, rank) of each element, by hashes of the element alone, at one dart for a
unit of area. A set keeps the darts that fall below its elements' weights; for each of k coordinates (a hash of the dart) the
one of least rank counts. Two sets agree in a coordinate with a probability that is their weighted Jaccard similarity.
About k log k darts are looked at for each set, whatever its size.

Copies with equal shingle sets are one node. Three steps find all links between the others, and no row stands for a pair
but for those of spanning forests, so the rows are in proportion to the nodes whatever the size of a group:

1. Nodes that share a band of coordinates meet in its bucket (large buckets block against block). A task ties together the
   nodes whose whole signatures agree by LIKELY, and gives a spanning forest of these ties.
2. The components of all forests are the groups within which links can be. Nodes of a group meet once with their shingle
   sets; those of a large group meet by its buckets, again block against block.
3. A task compares sets exactly: sets at the similarity share one of their rarest shingles, so only sets that do are
   compared, and only while they are in different classes. It gives a spanning forest of the links.

Classes are the connected components of these links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.words import KERNEL_BYTES, Words, mix, record_batch, run_hashes, slices
from samewise.operators.graph import components
from samewise.session import drop_written, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Nodes whose signatures agree less are not compared: at similarity 0.8, 120 coordinates fall this low once in ten million.
LIKELY = 0.6
#: Most nodes of a block; two blocks at most meet in a task.
BLOCK = 4096
#: Most shingles of a block of more than one node, 4 bytes each.
BLOCK_SHINGLES = 4 << 20
#: Most nodes of a group that meet in one task, or in blocks of it; nodes of larger groups meet by buckets.
GROUP = 1 << 16
FIRST_RANK = 0.25


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events."""
    n = int(mean + 12 * math.sqrt(mean) + 24)
    logs = np.arange(n) * math.log(mean) - mean - np.cumsum(np.log(np.maximum(1, np.arange(n))))
    return np.cumsum(np.exp(logs))


def dart_minhash(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """Signatures (n_sets x k least ranks) of weighted sets: elements (hashes) with weights, of the sets numbered in `sets`.

    An element stands once in a set. Sets without elements have infinite ranks.
    """
    out = np.full((n_sets, k), np.inf)
    total = np.bincount(sets, weights=weights, minlength=n_sets)
    reach = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    begun = np.zeros(n_sets)
    todo = np.arange(len(elements))
    while len(todo):
        e, w, s = elements[todo], weights[todo], sets[todo]
        top_w = float(w.max())
        low_w, cell_w = 0.0, 0
        while low_w < top_w:
            high_w = 1.0 if cell_w == 0 else low_w * 2
            low_r, cell_r = 0.0, 0
            while True:
                high_r = FIRST_RANK if cell_r == 0 else low_r * 2
                use = np.flatnonzero((reach[s] > low_r) & (begun[s] < high_r) & (w > low_w))
                if not len(use) and low_r >= reach[s].max():
                    break
                if len(use):
                    cell = mix(e[use], 1000 * cell_w + cell_r + 1)
                    n = np.searchsorted(_poisson((high_w - low_w) * (high_r - low_r)), _unit(cell), "right")
                    hit = n > 0
                    row, n, cell = use[hit], n[hit], cell[hit]
                    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    row = np.repeat(row, n)
                    dart = mix(np.repeat(cell, n) + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 17)
                    rank = low_r + (high_r - low_r) * _unit(mix(dart, 18))
                    good = (low_w + (high_w - low_w) * _unit(dart) < w[row]) & (rank <= reach[s[row]])
                    row, rank, dart = row[good], rank[good], dart[good]
                    np.minimum.at(out.reshape(-1), s[row] * k + (mix(dart, 19) % np.uint64(k)).astype(np.int64), rank)
                low_r, cell_r = high_r, cell_r + 1
            low_w, cell_w = high_w, cell_w + 1
        short = (total > 0) & np.isinf(out).any(1)
        begun = reach.copy()
        reach = np.where(short, reach * 2, reach)
        todo = np.flatnonzero(short[sets])
    return out


def shingle_sets(column: pa.ChunkedArray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text: (hash, text number, how often). Texts of fewer than k words have one shingle, all their words; texts without words none."""
    words = Words(column)
    at = np.flatnonzero(words.whole(k))
    h, t = words.shingles(k)[at], words.texts[at]
    n = np.diff(words.firsts)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h = np.concatenate([h, run_hashes(words.hashes, words.firsts[short], words.firsts[short + 1])])
        t = np.concatenate([t, short])
    _, which, count = np.unique(h ^ mix(t.astype(np.uint64), 23), return_index=True, return_counts=True)
    which = which[order := np.argsort(t[which], kind="stable")]
    return h[which], t[which], count[order]


def sketches(words: int, bands: int, rows: int, weighted: bool):
    k = bands * rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 36
        for table in slices(batches, most_bytes=KERNEL_BYTES):
            h, t, count = shingle_sets(table["text"], words)
            n = table.num_rows
            ranks = dart_minhash(h, count.astype(float) if weighted else np.ones(len(h)), t, n, k)
            bits = mix(ranks.view(np.uint64), 29)
            band = np.zeros((n, bands), np.uint64)
            for j in range(rows):
                band = mix(band + bits[:, j::rows][:, :bands], 31 + j)
            band = mix(band + np.arange(bands, dtype=np.uint64)[None, :], 37)
            size = np.bincount(t, weights=count if weighted else None, minlength=n).astype(np.int64)
            node = np.zeros(n, np.uint64)
            weight = count.astype(np.uint64) if weighted else np.uint64(1)
            np.add.at(node, t, mix(h + weight, 41))
            own = (mix(node, 43) ^ size.astype(np.uint64)).view(np.int64)
            coarse = (bits & np.uint64(255)).astype(np.uint8)
            yield record_batch(["row", "doc_id", "text_hash", "node", "size", "bands", "coarse"], [
                np.arange(seen, seen + n), table["doc_id"].combine_chunks(), table["text_hash"].combine_chunks(), pa.array(own, pa.int64(), mask=size == 0), size,
                pa.array([b.tobytes() for b in band], pa.binary()), pa.array([c.tobytes() for c in coarse], pa.binary()),
            ])
            seen += n

    return work


def band_rows(bands: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b["bands"].to_pylist()), np.int64)
            yield record_batch(["key", "id"], [keys, np.repeat(b["id"].to_numpy(), bands)])

    return work


class Parts:
    """Rows sorted by part (key, salt), over batches: gives the rows of whole parts, as many as came, as columns."""

    def __init__(self, columns: list[str]):
        self.columns, self.held = ["key", "salt", *columns], None

    @staticmethod
    def _column(c: pa.Array) -> np.ndarray:
        return np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_numpy()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """(bounds of the parts, columns but key and salt)."""
        for batch in batches:
            if batch.num_rows:
                rows = [self._column(batch[c]) for c in self.columns]
                if self.held is not None:
                    rows = [np.concatenate(x) for x in zip(self.held, rows, strict=True)]
                cut = self._cuts(rows)
                last = cut[-1] if len(cut) else 0
                self.held = [x[last:] for x in rows]
                if last:
                    yield np.append(0, cut), [x[:last] for x in rows[2:]]
        if self.held is not None:
            yield np.concatenate([[0], self._cuts(self.held), [len(self.held[0])]]), self.held[2:]

    @staticmethod
    def _cuts(rows: list[np.ndarray]) -> np.ndarray:
        return np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1


def _tied(coarse: np.ndarray, near_first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Ties (one, others) of a spanning forest of the members that agree by LIKELY; near_first: those that do with the first one.

    Each member that was reached looks only at those that weren't yet.
    """
    least = LIKELY * coarse.shape[1] - 1e-9
    todo = np.flatnonzero(~near_first)
    todo = todo[todo > 0]
    reached = [0, *np.flatnonzero(near_first[1:]) + 1]
    while len(todo):
        if not reached:
            reached, todo = [int(todo[0])], todo[1:]
        x = reached.pop()
        near = np.count_nonzero(coarse[todo] == coarse[x], axis=1) >= least
        if near.any():
            yield x, todo[near]
            reached.extend(todo[near].tolist())
            todo = todo[~near]


def likely_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, salt, id, coarse) sorted by part: a spanning forest (a, b) of each part's likely pairs."""
    for bounds, (ids, blobs) in Parts(["id", "coarse"])(batches):
        coarse = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(ids), -1)
        size = np.diff(bounds)
        lead = np.repeat(bounds[:-1], size)
        near = np.count_nonzero(coarse == coarse[lead], axis=1) >= LIKELY * coarse.shape[1] - 1e-9  # with the part's first row
        a, b = [ids[lead[near]]], [ids[near]]
        for p in np.flatnonzero((np.add.reduceat(~near, bounds[:-1]) > 0) & (size > 2)).tolist():
            s, e = bounds[p], bounds[p + 1]
            for x, others in _tied(coarse[s:e], near[s:e]):
                a.append(np.full(len(others), ids[s + x]))
                b.append(ids[s + others])
        a, b = np.concatenate(a), np.concatenate(b)
        keep = a != b
        yield record_batch(["a", "b"], [np.minimum(a, b)[keep], np.maximum(a, b)[keep]])


class ShingleSets:
    """Sets of some parts, one after another, with what an exact search for links needs: postings of each set's rarest shingles."""

    def __init__(self, bounds: np.ndarray, blobs: np.ndarray, similarity: float):
        self.similarity = similarity
        self.part = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        self.size = np.array([len(b) // 4 for b in blobs], np.int64)
        self.ends = np.append(0, np.cumsum(self.size))
        row = np.repeat(np.arange(len(blobs)), self.size)
        names = (self.part[row] << np.uint64(32)) | np.frombuffer(b"".join(blobs), np.uint32).astype(np.uint64)  # parts share no shingle
        _, code, count = np.unique(names, return_inverse=True, return_counts=True)
        rarity = np.argsort(np.argsort(count, kind="stable"), kind="stable")[code]
        order = np.lexsort((rarity, row))
        self.code = code[order]
        # sets of the similarity share at least one shingle of the beginnings, in one order of all shingles
        begin = self.size - np.ceil(similarity * self.size - 1e-9).astype(np.int64) + 1
        place = np.arange(len(row)) - self.ends[row]
        use = np.flatnonzero((place < begin[row]) & (count[self.code] > 1))
        by = np.argsort(self.code[use], kind="stable")  # rows stay in order
        self.rows, codes = row[use][by], self.code[use][by]
        self.n_codes = len(count)
        self.at = np.searchsorted(codes, np.arange(self.n_codes + 1))
        self.begins = np.searchsorted(row[use], np.arange(len(blobs) + 1))
        self.begin_codes = self.code[use]
        self.marked = np.zeros(self.n_codes, bool)

    def earlier(self, x: int) -> np.ndarray:
        """Sets before x that share one of the beginning's shingles."""
        codes = self.begin_codes[self.begins[x] : self.begins[x + 1]]
        found = [self.rows[self.at[c] : self.at[c + 1]] for c in codes.tolist() if self.at[c + 1] - self.at[c] > 1]
        found = [f[: np.searchsorted(f, x)] for f in found]
        found = [f for f in found if len(f)]
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def links(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that reach the similarity with x."""
        nx, n = self.size[x], self.size[others]
        others = others[np.minimum(n, nx) >= self.similarity * np.maximum(n, nx)]
        if not len(others):
            return others
        mine = self.code[self.ends[x] : self.ends[x + 1]]
        self.marked[mine] = True
        n = self.size[others]
        to = np.cumsum(n) - n
        flat = np.repeat(self.ends[others] - to, n) + np.arange(int(n.sum()))
        shared = np.add.reduceat(self.marked[self.code[flat]].astype(np.int64), to)
        self.marked[mine] = False
        return others[shared >= self.similarity * (nx + n - shared)]


def exact_forest(similarity: float):
    """Over rows (key, salt, block, id, shingles) sorted by part: a spanning forest (a, b) of each part's links.

    Parts of two blocks have rows of both; two sets of one block meet in a part of that block alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, (block, ids, blobs) in Parts(["block", "id", "shingles"])(batches):
            sets = ShingleSets(bounds, blobs, similarity)
            label = np.arange(len(ids))
            two = np.minimum.reduceat(block, bounds[:-1]) != np.maximum.reduceat(block, bounds[:-1])
            out: list[tuple[int, int]] = []
            for x in np.flatnonzero(np.diff(sets.begins) > 0).tolist():
                others = sets.earlier(x)
                others = others[label[others] != label[x]]
                p = int(sets.part[x])
                if two[p]:
                    others = others[block[others] != block[x]]
                if not len(others):
                    continue
                own = label[bounds[p] : bounds[p + 1]]
                for y in sets.links(x, others).tolist():
                    if label[x] != label[y]:
                        out.append((ids[x], ids[y]))
                        own[own == label[y]] = label[x]
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield record_batch(["a", "b"], [np.minimum(a, b), np.maximum(a, b)])

    return work


def blocked(members: DataFrame, block: int, shingles: int | None = None) -> DataFrame:
    """(key, salt, block, id) of members (key, id, size) of keys of two members or more.

    Keys of at most `block` members, of so many shingles, are one part. Members of larger keys are dealt over blocks of such sizes, and
    each two blocks of a key are a part, as is each block alone. (The number of parts grows with the square of a key's blocks; the
    rows of one part don't.)
    """
    enough = F.ceil(F.count("*") / block) if shingles is None else F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.col("size").cast("double")) / shingles))
    counted = members.groupBy("key").agg(F.count("*").alias("n"), enough.cast("long").alias("blocks")).where("n > 1").drop("n")
    dealt = members.join(counted, "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block")))
    return dealt.select("key", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(meets)).alias("salt"), "block", "id")


def in_parts(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt")


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for a shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield record_batch(["doc_id", "text_hash", "text"], [b["doc_id"], b["text_hash"], pa.array([pack((t or "").encode()) for t in b["text"].to_pylist()], pa.binary())])


def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            yield record_batch(["id", "text"], [part["id"], pa.array([unpack(x).decode() for x in part["text"].to_pylist()], pa.large_string())])


def shingle_blobs(words: int, weighted: bool = False):
    """32-bit hashes of each text's shingles, each once; with weighted, the n-th occurrence of a shingle has its own hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(unzipped(batches), most_bytes=KERNEL_BYTES):
            h, t, count = shingle_sets(table["text"], words)
            if weighted:
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                h, t = mix(np.repeat(h, count) + nth.astype(np.uint64), 47), np.repeat(t, count)
            h = (h >> np.uint64(32)).astype(np.uint32)
            ends = np.searchsorted(t, np.arange(table.num_rows + 1))
            yield record_batch(["id", "shingles"], [table["id"].combine_chunks(), pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())])

    return work


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id, kept, text_hash) for each row of docs (doc_id, text, further columns that don't matter).

    class_id is the least doc_id of the class, kept is true for one row of each class, of that doc_id, and text_hash (xxhash64 of the text)
    tells rows of one doc_id apart: they are texts of their own and are in one class only if their texts are alike. Repeated rows
    share a class and one of them is kept. Texts without words, null texts and rows without doc_id are alone and kept (class_id
    is their doc_id). An empty table gives an empty result. Texts of fewer than `words` words have one shingle, all their words. With
    weighted, similarity and signatures count how often a shingle occurs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    drawn = written(texts.mapInArrow(sketches(words, bands, rows, weighted), "row long, doc_id long, text_hash long, node long, size long, bands binary, coarse binary"), "sketches")
    named = drawn.where("node is not null and doc_id is not null")
    # a node's lead is the row that stands for its texts
    nodes = written(named.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "row")).alias("lead")), "nodes")
    lead = drawn.join(nodes.select(F.col("lead.row").alias("row")), "row", "left_semi").select(F.col("node").alias("id"), "size", "bands", "coarse")
    keyed = lead.select("id", "bands").mapInArrow(band_rows(bands), "key long, id long")
    members = blocked(keyed.withColumn("size", F.lit(0)), BLOCK).join(lead.select("id", "coarse"), "id")
    ties = in_parts(members.select("key", "salt", "id", "coarse"))
    groups = written(components(ties, made=likely_forest).join(lead.select("id", "size"), "id"), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    whole = groups.join(sizes.where(F.col("n") <= GROUP), "component").select(F.col("component").alias("key"), "id", "size")
    large = groups.join(sizes.where(F.col("n") > GROUP), "component").select("id", "size")
    met = blocked(whole.unionByName(keyed.join(large, "id").select("key", "id", "size")), BLOCK, BLOCK_SHINGLES)
    small = texts.where("doc_id is not null").mapInArrow(zipped, "doc_id long, text_hash long, text binary")
    wanted = nodes.join(groups.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("id"), "lead.doc_id", "lead.text_hash")
    sets = small.join(wanted.hint("merge"), ["doc_id", "text_hash"]).select("id", "text").mapInArrow(shingle_blobs(words, weighted), "id long, shingles binary")
    parts = in_parts(met.join(sets.dropDuplicates(["id"]), "id").select("key", "salt", "block", "id", "shingles"))
    found = components(parts, made=exact_forest(similarity))
    classes = nodes.join(found, nodes["node"] == found["id"], "left").select("node", "lead", F.coalesce("component", "node").alias("class"))
    least = classes.groupBy("class").agg(F.min("lead").alias("first"))
    told = written(classes.join(least, "class").select("node", "first"), "classes")
    drop_written(groups)
    out = named.select("row", "doc_id", "text_hash", "node").join(told, "node")
    out = out.select("doc_id", F.col("first.doc_id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"), "text_hash")
    return out.unionByName(drawn.where("node is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "text_hash"))
