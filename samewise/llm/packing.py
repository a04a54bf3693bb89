"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Each document is tokenised once, in bounded blocks; only pieces (document, place, length, checksum) travel. Best fit
decreasing needs no more than how many pieces there are of each length, at most `capacity` numbers: the driver plans
with a segment tree over remaining capacities, where pieces of one length and bins of one remaining capacity move
together, so the plan has a bounded size whatever the number of documents. It is the plan of the sequential algorithm.
Pieces then find their bin by their rank among those of their length: rank within the task that cut them plus the number in earlier tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.words import KERNEL_BYTES, Words, record_batch, slices
from samewise.session import written

CAPACITY = 4096
END_ID = 1
#: Words that a Python worker remembers.
REMEMBERED = 700_000
#: Tasks whose counts are added up by one window.
RANGE = 1024


class WordBpe:
    """Ids of the BPE with word ends of word_bpe_49k.json, for many words that hold no white space at once.

    Common words (letters below U+0250, digits, ASCII signs) go together through a byte-pair merger in which the word end
    is the byte 0x7F; all others, and words that could hold a special token, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {}
        for token, i in vocabulary.items():
            if token.startswith("<|") and token.endswith("|>"):
                continue
            end = token.endswith("</w>") and token != "</w>"
            ranks[bytes(letters[c] for c in (token[:-4] if end else token)) + b"\x7f" * end] = i
        self.space = ranks[b" "]
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x7f ]+\x7f| ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.parts = regex.compile(r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)").sub
        self.odd = regex.compile(r"[^\x20-\x7e¡-ɏ]|<\||İ").search

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and how many each word has."""
        text = " ".join(words)
        if not self.odd(text):
            flat = np.array(self.merge(self.parts("\\1\x7f", text.lower())), np.uint32)
            gaps = flat == self.space
            return flat[~gaps], np.diff(np.concatenate([[-1], np.flatnonzero(gaps), [len(flat)]])) - 1
        odd = [bool(self.odd(w)) for w in words]
        each: list = [None] * len(words)
        if plain := [w for w, o in zip(words, odd, strict=True) if not o]:
            flat, n = self(plain)
            parts = iter(np.split(flat, np.cumsum(n)[:-1]))
        for i, (w, o) in enumerate(zip(words, odd, strict=True)):
            each[i] = np.array(self.whole.encode(w, add_special_tokens=False).ids, np.uint32) if o else next(parts)
        return np.concatenate(each), np.array([len(x) for x in each])


class WordCache:
    """Ids of many words: different words are encoded once and their ids stand in one array."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def rows(self, words: Words) -> np.ndarray:
        """Row of each word: its ids are flat[bounds[row]:bounds[row + 1]]."""
        values, which, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.remembered:
            self._clear()
        known = self.known
        out = np.array([known.get(h, -1) for h in values.tolist()], np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            raw = words.raw.tobytes()
            flat, n = self.encode([raw[a:b].decode() for a, b in zip(words.starts[which[new]].tolist(), words.ends[which[new]].tolist(), strict=True)])
            out[new] = np.arange(len(new)) + len(known)
            known.update(zip(values[new].tolist(), out[new].tolist(), strict=True))
            self.bounds = np.concatenate([self.bounds, len(self.flat) + np.cumsum(n)])
            self.flat = np.concatenate([self.flat, flat])
        return out[inverse]

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the texts' bounds."""
        rows = self.rows(words)
        begin, length = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        to = np.append(0, np.cumsum(length))
        flat = self.flat[np.repeat(begin - to[:-1], length) + np.arange(to[-1])]
        return flat, to[words.firsts]


def pieces(path: str, capacity: int = CAPACITY, end_id: int = END_ID, encoder: Callable[[str], Callable] = WordBpe):
    """For mapInArrow over (doc_id, text): a row for each piece, with its task and rank among the task's pieces of that length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = WordCache(encoder(path)), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for table in slices(batches, most_bytes=KERNEL_BYTES):
            flat, bounds = cache.ids(Words(table["text"]))
            rows: list[tuple] = []
            for doc, a, b in zip(table["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            length = np.array([r[3] for r in rows])
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows)) - first
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield record_batch(["task", "doc_id", "piece", "start", "length", "ids_crc32", "rank"], [
                pa.array([task] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)), pa.array(rank, pa.int64()),
            ])

    return work


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest one that is large enough in logarithmic time.

    Bins of one remaining capacity are kept as ranges of bin numbers.
    """

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.size)  # bins below each node
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _add(self, left: int, n: int) -> None:
        at = left + self.size
        while at:
            self.open[at] += n
            at //= 2

    def put(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.ranges[left].append((first, n))
            self._add(left, n)

    def tightest(self, need: int) -> int:
        """Least remaining capacity >= need of any open bin; 0 if there is none."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    at += not self.open[at]
                return at - self.size
            at //= 2
        return 0

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to most bins of one range with that remaining capacity."""
        first, n = self.ranges[left].pop()
        if n > most:
            self.ranges[left].append((first + most, n - most))
            n = most
        self._add(left, -n)
        return first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit decreasing of counts[length] pieces. Rows (length, rank of the first piece, first bin, pieces in each bin, place in the bin).

    The piece of rank r (from the row's first) goes to bin first + r // k at place + length * (r % k), where k is the number in each bin.
    """
    bins, made, rows = OpenBins(capacity), 0, []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length) or capacity
            each = room // length  # the tightest bin stays the tightest until it is too full
            if left < each:
                each = left
            want = left // each
            if bins.ranges[room]:
                first, n = bins.take(room, want)
            else:
                first, n = made, want
                made += want
            rows.append((length, rank, first, each, capacity - room))
            bins.put(room - each * length, first, n)
            left -= n * each
            rank += n * each
    return np.array(rows, np.int64).reshape(-1, 5)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, encoder: Callable[[str], Callable] = WordBpe) -> DataFrame:
    """A row for each piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have one piece, the end id alone. Repeated rows, and rows without doc_id, are packed each. Only texts of more than
    capacity ids are cut. Further columns don't matter; an empty table gives an empty result.
    """
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces(path, capacity, end_id, encoder), "task long, doc_id long, piece int, start long, length long, ids_crc32 long, rank long")
    cut = written(cut, "packing-pieces")
    in_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    # a length has a row for each task, or, above, for each RANGE of them
    ranges = in_task.groupBy(F.floor(F.col("task") / RANGE).alias("range"), "length").agg(F.sum("n").alias("n"))
    earlier = lambda order, *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "length").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = in_task.withColumn("range", F.floor(F.col("task") / RANGE)).withColumn("lower", earlier("task", "range")).drop("n")
    before = lower.join(ranges.withColumn("upper", earlier("range")).drop("n"), ["range", "length"]).select("task", "length", (F.col("lower") + F.col("upper")).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    steps = plan(counts, capacity)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = docs.sparkSession.sparkContext.broadcast(steps[order])  # bounded by capacity, not by documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = steps.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            row = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            r = rank - row[:, 1]
            yield record_batch(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], [b["doc_id"], b["piece"], b["start"], b["length"], b["ids_crc32"], row[:, 2] + r // row[:, 3], row[:, 4] + length * (r % row[:, 3])])

    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
