"""Words, hashes and batches of texts as numpy arrays.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. All hashes are 64-bit; the hash of a run of items is a
polynomial in a random odd base modulo 2**64, so any run's hash comes from two prefix sums.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BASE = 0x9E6C63D0876A9A35 | 1
#: Text that the kernels of scores, signatures and pieces take at once: their arrays are up to seventy times as much, in each Python worker.
KERNEL_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 2**64)
    out = []
    for b in (BASE, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    forward, back = _powers(size) if size <= 1 << 23 else _powers.__wrapped__(size)
    return forward[:n], back[:n]


def run_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of items[s:e] for each s, e; equal runs have equal hashes wherever they stand."""
    forward, back = powers(len(items) + 1)
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * forward[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts], 7) ^ mix((ends - starts).astype(np.uint64), 11)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word, eight at a time: all words take their next eight bytes together."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))
    length = ends - starts
    low = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    mask = np.append(low, np.uint64(2**64 - 1))
    out = mix(eight[starts] & mask[np.minimum(length, 8)] ^ (length.astype(np.uint64) << np.uint64(56)), 5)
    left = np.flatnonzero(length > 8)
    done = 8
    while len(left):
        part = eight[starts[left] + done] & mask[np.minimum(length[left] - done, 8)]
        out[left] = mix(out[left] * np.uint64(BASE) + part, 6)
        done += 8
        left = left[length[left] > done]
    return out


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after another, and the texts' bounds (one more than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def plain_letters(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of as many bytes: A-Z and the capitals U+00C0-U+00DE in lower case, ASCII signs as spaces."""
    out = _PLAIN[raw]
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1
    at = at[(raw[at] >= 0x80) & (raw[at] <= 0x9E) & (raw[at] != 0x97)]
    out[at] += 32
    return out


class Words:
    """All words of some texts: starts and ends in the byte buffer, text number and hash of each, and each text's first word."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, plain: bool = False):
        self.raw, bounds = text_buffer(column)
        if plain:
            self.raw = plain_letters(self.raw)
        n = len(self.raw)
        solid = ~SPACE[self.raw]
        first = np.empty(n, bool)
        last = np.empty(n, bool)
        if n:
            first[0], first[1:] = True, ~solid[:-1]
            last[-1], last[:-1] = True, ~solid[1:]
            inner = bounds[(bounds > 0) & (bounds < n)]
            first[inner] = True
            last[inner - 1] = True
        self.starts = np.flatnonzero(first & solid)
        self.ends = np.flatnonzero(last & solid) + 1
        self.bounds = bounds
        self.firsts = np.searchsorted(self.starts, bounds)
        self.texts = np.repeat(np.arange(len(bounds) - 1), np.diff(self.firsts))
        self.hashes = word_hashes(self.raw, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of each k words that follow one another, from the first word of any text on; those that cross texts are for the caller to drop."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = self.hashes
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(BASE) + h[j : j + n]
        return mix(out, k)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each position on are of one text."""
        n = len(self) - k + 1
        return self.texts[:n] == self.texts[k - 1 :] if n > 0 else np.zeros(0, bool)

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4 << 20, most_rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Deals rows out anew, in order, into tables of at most most_bytes of text (a longer text stands alone)."""
    held: list[pa.Table] = []
    size = rows = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        lengths = np.diff(text_buffer(table[text])[1])
        start, n = 0, len(lengths)
        for i in range(n):
            if (size and size + lengths[i] > most_bytes) or rows >= most_rows:
                if i > start:
                    held.append(table.slice(start, i - start))
                yield pa.concat_tables(held)
                held, size, rows, start = [], 0, 0, i
            size += int(lengths[i])
            rows += 1
        if n > start:
            held.append(table.slice(start))
    if held:
        yield pa.concat_tables(held)


def packed(table: pa.Table) -> bytes:
    """A table as compressed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def in_blocks(df: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """Rows of df (with a column text) as blocks: block (a number that a retried task gives again), n_bytes of text and blob, the packed rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, table in enumerate(slices(batches, most_bytes=most_bytes)):
            size = int(text_buffer(table["text"])[1][-1])
            yield pa.RecordBatch.from_pydict({"block": pa.array([(task << 32) + i], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "blob": pa.array([packed(table)], pa.binary())})

    return df.mapInArrow(pack, "block long, n_bytes long, blob binary")


def record_batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
