"""SentencePiece encoding and decoding in batched numpy.

Texts are cut into units, runs of spaces with the word behind them, which no piece crosses. Each different unit is
encoded once in a block. Units of equal length advance together: hashes of all their substrings probe the sorted hashes of
the pieces, which gives a table of scores by place and length. For a unigram model a Viterbi pass over that table keeps, by
vectorised maxima, the best score and a backpointer for each place. A BPE model is not the best sum of scores, so for it
the same table drives merges instead: in each round every unit joins its best neighbouring pair (the leftmost of equals). Characters that
are no piece become byte pieces, or the unknown id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samewise.llm.words import BASE, Words, mix, record_batch, slices, word_hashes

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
SPACE_MARK = "▁"
REMEMBERED = 700_000
#: Units of more characters than this are encoded one by one.
LONG = 256
#: Cells of a table of scores at once.
CELLS = 4_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: numbers, or bytes (of strings, messages and fixed widths)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + n]
        at += n


class PieceModel:
    """Pieces, scores and kinds of a model file, with the sorted hashes of those that texts can match."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], kind: int = UNIGRAM, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        kinds_, all_scores = np.array(kinds), np.array(scores, np.float64)
        usable = np.flatnonzero(np.isin(kinds_, (NORMAL, USER)))
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        hashes = np.array([piece_hash(pieces[i]) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], usable[order]
        self.scores = all_scores[self.ids]
        self.unknown = int(np.flatnonzero(kinds_ == UNKNOWN)[0]) if (kinds_ == UNKNOWN).any() else 0
        self.bytes = {int(pieces[i][3:5], 16): int(i) for i in np.flatnonzero(kinds_ == BYTE)}
        self.unknown_score = float(self.scores.min(initial=0.0)) - 10
        self.lookup = {pieces[i]: (float(all_scores[i]), int(i)) for i in usable}
        of_byte = {i: b for b, i in self.bytes.items()}
        out = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([of_byte[i]]) if k == BYTE else p.replace(SPACE_MARK, " ").encode() for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]
        self.flat = np.frombuffer(b"".join(out), np.uint8)
        self.bounds = np.append(0, np.cumsum([len(x) for x in out]))

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as file:
            data = file.read()
        pieces, scores, kinds, kind, dummy = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append(f.get(1, b"").decode())
                scores.append(float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0]))
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                dummy = bool(dict(_fields(value)).get(3, 1))
        return cls(pieces, scores, kinds, kind, dummy)

    def table(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of all substrings of equal-length units: unit x place x (length - 1); -inf and -1 where there is no piece."""
        n, width = codes.shape
        most = min(self.longest, width)
        scores, ids = np.full((n, width, most), -np.inf), np.full((n, width, most), -1, np.int64)
        h = np.zeros((n, width), np.uint64)
        for k in range(most):
            w = width - k
            h = h[:, :w] * np.uint64(BASE) + mix(codes[:, k:].astype(np.uint64), 81)
            key = mix(h, k + 1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            scores[:, :w, k][hit] = self.scores[at[hit]]
            ids[:, :w, k][hit] = self.ids[at[hit]]
        return scores, ids

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Lengths of the best segmentation at each place where a piece begins, else 0. A character without a piece counts as unknown."""
        n, width, most = scores.shape
        single = np.where(np.isneginf(scores[:, :, 0]), self.unknown_score, scores[:, :, 0])
        best, back = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, width + 1):
            longest = min(most, end)
            options = np.stack([best[:, end - k] + (single[:, end - 1] if k == 1 else scores[:, end - k, k - 1]) for k in range(longest, 0, -1)])
            choice = options.argmax(0)
            best[:, end] = options[choice, np.arange(n)]
            back[:, end] = longest - choice
        lengths, at, rows = np.zeros((n, width), np.int64), np.full(n, width), np.arange(n)
        while (open_ := at > 0).any():
            k = back[rows[open_], at[open_]]
            at[open_] -= k
            lengths[rows[open_], at[open_]] = k
        return lengths

    def merges(self, scores: np.ndarray) -> np.ndarray:
        """The same for byte-pair merges: the pair of best score is joined first, of equals the leftmost."""
        n, width, most = scores.shape
        ends = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        open_ = np.ones((n, width), bool)
        rows, places = np.arange(n), np.arange(width)
        padded = np.concatenate([ends, np.full((n, 1), width)], axis=1)
        while len(rows):
            e, o = padded[rows], open_[rows]
            after = np.take_along_axis(e, e[:, :-1], 1)
            size = after - places
            good = o & (e[:, :-1] < width) & (size <= most)
            value = np.where(good, scores[rows[:, None], places[None, :], np.minimum(size, most) - 1], -np.inf)
            at = value.argmax(1)
            found = value[np.arange(len(rows)), at] > -np.inf
            rows, at, after = rows[found], at[found], after[found]
            if len(rows):
                open_[rows, padded[rows, at]] = False
                padded[rows, at] = after[np.arange(len(rows)), at]
        return np.where(open_, padded[:, :-1] - places, 0)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after another, and how many each has."""
        each: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            if not size:
                continue
            if size > LONG:
                for i in which:
                    each[i] = self._one(units[i])
                continue
            step = max(1, CELLS // int(size * min(size, self.longest)))
            for a in range(0, len(which), step):
                part = which[a : a + step]
                codes = np.frombuffer("".join(units[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), size)
                scores, ids = self.table(codes)
                lengths = self.viterbi(scores) if self.kind == UNIGRAM else self.merges(scores)
                row, place = np.nonzero(lengths)
                found = ids[row, place, lengths[row, place] - 1]
                missing = np.flatnonzero(found < 0)
                count = np.ones(len(found), np.int64)
                if len(missing):
                    fall = [self._fallback(chr(codes[row[m], place[m]])) for m in missing]
                    count[missing] = [len(f) for f in fall]
                    out = np.repeat(found, count)
                    starts = np.cumsum(count) - count
                    for m, f in zip(missing, fall, strict=True):
                        out[starts[m] : starts[m] + len(f)] = f
                    found = out
                per = np.bincount(row, weights=count, minlength=len(part)).astype(np.int64)
                for i, ids_ in zip(part, np.split(found, np.cumsum(per)[:-1]), strict=True):
                    each[i] = ids_
        return np.concatenate(each) if each else np.zeros(0, np.int64), np.array([len(x) for x in each], np.int64)

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _one(self, unit: str) -> np.ndarray:
        """A long unit by itself: Viterbi in one row, or merges with a heap."""
        if self.kind == UNIGRAM:
            codes = np.frombuffer(unit.encode("utf-32-le"), "<u4").reshape(1, -1)
            scores, ids = self.table(codes)
            lengths = self.viterbi(scores)[0]
            return np.concatenate([[i] if (i := ids[0, p, lengths[p] - 1]) >= 0 else self._fallback(unit[p]) for p in np.flatnonzero(lengths)]).astype(np.int64)
        import heapq

        n = len(unit)
        end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (hit := self.lookup.get(unit[a : end[b]])):
                heapq.heappush(heap, (-hit[0], a, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not live[a] or b >= n or end[b] != stop:
                continue
            live[b], end[a] = False, stop
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        for a in range(n):
            if live[a]:
                hit = self.lookup.get(unit[a : end[a]])
                out += [hit[1]] if hit else self._fallback(unit[a])
        return np.array(out, np.int64)


def piece_hash(piece: str) -> int:
    """As PieceModel.table() hashes substrings."""
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = h * np.uint64(BASE) + mix(np.array([ord(c)], np.uint64), 81)
    return int(mix(h, len(piece))[0])


class Encoder:
    """Encodes columns of texts; different units are remembered, up to a bound."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def units(self, column: pa.ChunkedArray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of bytes that make up the texts: starts, ends, and where each text's begin."""
        words = Words(column)
        n = len(words.raw)
        other = np.where(words.raw != 0x20, np.arange(n), -1)
        np.maximum.accumulate(other, out=other)
        text_start = words.bounds[words.texts]
        begin = np.maximum(text_start, np.where(words.starts > 0, other[np.maximum(words.starts - 1, 0)], -1) + 1)
        first = np.ones(len(words), bool)
        first[1:] = words.texts[1:] != words.texts[:-1]
        previous = np.where(first, text_start, np.append(0, words.ends[:-1]))
        last = words.firsts[1:] - 1
        has = np.diff(words.firsts) > 0
        tail = np.where(has, words.ends[np.maximum(last, 0)] if len(words) else 0, words.bounds[:-1])
        starts = np.concatenate([begin, previous, tail])
        ends = np.concatenate([words.ends, begin, words.bounds[1:]])
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        return words, starts, ends, np.searchsorted(starts, words.bounds)

    def ids(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the texts' bounds."""
        words, starts, ends, cuts = self.units(column)
        leads = np.zeros(len(starts), bool)
        if self.model.dummy_prefix:
            leads[cuts[:-1][np.diff(cuts) > 0]] = True
        h = word_hashes(words.raw, starts, ends)
        h[leads] = mix(h[leads], 71)
        values, which, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._clear()
        rows = np.array([self.known.get(x, -1) for x in values.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = words.raw.tobytes()
            units = [(SPACE_MARK if lead else "") + raw[a:b].decode().replace(" ", SPACE_MARK) for a, b, lead in zip(starts[which[new]].tolist(), ends[which[new]].tolist(), leads[which[new]].tolist(), strict=True)]
            flat, n = self.model.encode_units(units)
            rows[new] = np.arange(len(new)) + len(self.known)
            self.known.update(zip(values[new].tolist(), rows[new].tolist(), strict=True))
            self.bounds = np.concatenate([self.bounds, len(self.flat) + np.cumsum(n)])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        row = rows[inverse]
        begin, length = self.bounds[row], self.bounds[row + 1] - self.bounds[row]
        to = np.append(0, np.cumsum(length))
        return self.flat[np.repeat(begin - to[:-1], length) + np.arange(to[-1])], to[cuts]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of ids (UTF-8; byte pieces as they are)."""
        m = self.model
        ids = ids.astype(np.int64)
        length = m.bounds[ids + 1] - m.bounds[ids]
        to = np.append(0, np.cumsum(length))
        data = m.flat[np.repeat(m.bounds[ids] - to[:-1], length) + np.arange(to[-1])].tobytes()
        cuts = to[bounds].tolist()
        skip = int(m.dummy_prefix)
        return [data[a + skip if data[a : a + 1] == b" " else a : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip, ids) of docs (doc_id, text): ids as little-endian unsigned 32-bit numbers.

    round_trip: decoding the ids gives the text's bytes again. A row for each row of docs, by its text alone: repeated rows and rows
    without doc_id are encoded like others, null and empty texts have no ids, further columns don't matter, and an empty table gives
    an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PieceModel.load(path))
        for table in slices(batches):
            flat, bounds = encoder.ids(table["text"])
            flat = flat.astype("<u4")
            back = encoder.decode(flat, bounds)
            blobs = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            texts = table["text"].cast(pa.binary()).to_pylist()
            yield record_batch(["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"], [
                table["doc_id"].cast(pa.int64()).combine_chunks(), np.diff(bounds), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                pa.array([a == (b or b"") for a, b in zip(back, texts, strict=True)]), pa.array(blobs, pa.binary()),
            ])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids binary")
