"""A compressed full-text index over sequences of integers, in numpy, for patterns of bounded length.

Suffixes are sorted by their first `depth` symbols only, which is all that backward search of patterns of up to `depth`
symbols needs. The Burrows-Wheeler transform is held in a wavelet matrix of packed bits with a count for each 64, and where
suffixes begin to differ in packed bits too. The sorted suffixes themselves are only there while an index is built.
"""

from __future__ import annotations

import numpy as np


class PackedBits:
    """Bits in 64-bit words with running counts: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        low = self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[at] + np.bitwise_count(low)

    @property
    def n_bytes(self) -> int:
        return self.words.nbytes + self.counts.nbytes


class WaveletMatrix:
    """rank(symbol, i) over a sequence, in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits: list[PackedBits] = []
        self.zeros: list[int] = []
        row = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.bits.append(PackedBits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])
        ends = np.arange(n_symbols)
        self.base = self._walk(ends, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        return self._walk(symbol, i) - self.base[symbol]


class FMIndex:
    """Index of a text of symbols 1..n_symbols-1; 0 separates sequences. Patterns of up to depth (2 at least) symbols can be searched.

    With values, one for each place of the text, least holds the least value of each group of suffixes that agree in depth symbols.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int, values: np.ndarray | None = None):
        text = np.asarray(text, np.int64)
        n = len(text)
        self.depth, self.n = depth, n
        rank, span = text, 1
        shorter = None
        while span < depth:
            step = min(span, depth - span)
            if span + step == depth:  # before the last step, ranks by one symbol less
                less = depth - 1 - span
                shorter = self._pairs(rank, less) if less else rank
            rank = self._pairs(rank, step)
            span += step
        order = np.argsort(rank, kind="stable")
        new = self._new(rank[order])  # where suffixes that agree in depth symbols begin
        self.groups = PackedBits(new)
        self.least = np.minimum.reduceat(values[order], np.flatnonzero(new)) if values is not None and n else None
        new = self._new(shorter[order])  # and in depth - 1
        self.near = PackedBits(new)
        self.near_starts = np.append(np.flatnonzero(new), n)
        self.before = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.before[1:])
        self.bwt = WaveletMatrix(text[order - 1], n_symbols)

    @property
    def n_bytes(self) -> int:
        """Bytes of the index."""
        return sum(b.n_bytes for b in (*self.bwt.bits, self.groups, self.near)) + self.near_starts.nbytes + self.before.nbytes + self.bwt.base.nbytes + (0 if self.least is None else self.least.nbytes)

    @staticmethod
    def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
        n = len(rank)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        return np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1].astype(np.int64)

    @staticmethod
    def _new(sorted_ranks: np.ndarray) -> np.ndarray:
        out = np.ones(len(sorted_ranks), bool)
        out[1:] = sorted_ranks[1:] != sorted_ranks[:-1]
        return out

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: from the rows of X to the rows of symbol + X."""
        return self.before[symbol] + self.bwt.rank(symbol, low), self.before[symbol] + self.bwt.rank(symbol, high)

    def windows(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences flat[s:e], bounded by depth, read from right to left, all sequences together.

        Returns (sequence number, place in flat, group) of each window of depth symbols that is in the index. Once a
        window is matched, its rows widen to those of its first depth - 1 symbols, and one step gives the next window.
        After a mismatch the match begins again with the longest part that can still match: the symbols left of it.
        """
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), self.n)
        length = np.zeros(len(starts), np.int64)
        place = ends - 1
        alive = np.flatnonzero(place >= starts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(alive):
            at = place[alive]
            lo, hi, size = low[alive], high[alive], length[alive]
            full = size == self.depth
            if full.any():
                near = self.near.rank(lo[full] + 1) - 1
                lo[full], hi[full] = self.near_starts[near], self.near_starts[near + 1]
                size[full] -= 1
            lo, hi = self.step(flat[at], lo, hi)
            size += 1
            lost = lo >= hi
            if lost.any():
                lo, hi, size = self._shrink(flat, at, lo, hi, size, lost)
            low[alive], high[alive], length[alive] = lo, hi, size
            done = size == self.depth
            if done.any():
                found.append((alive[done], at[done], self.groups.rank(lo[done] + 1) - 1))
            place[alive] = at - 1
            alive = alive[at > starts[alive]]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _shrink(self, flat, at, lo, hi, size, lost):
        """The longest prefix of the lost match that occurs: each is searched anew, shorter by one each time."""
        todo = np.flatnonzero(lost)
        want = size[todo] - 1
        while len(todo):
            l, h = np.zeros(len(todo), np.int64), np.full(len(todo), self.n)
            for back in range(int(want.max(initial=0)) - 1, -1, -1):
                use = back < want
                l[use], h[use] = self.step(flat[at[todo[use]] + back], l[use], h[use])
            good = (l < h) | (want == 0)
            l[want == 0], h[want == 0] = 0, self.n
            k = todo[good]
            lo[k], hi[k], size[k] = l[good], h[good], want[good]
            todo, want = todo[~good], want[~good] - 1
        return lo, hi, size
