"""Token counts that follow edits.

A document's pre-tokens are the leaves of a tree that keeps, for each subtree, the characters and tokens below it. An edit
goes down the tree to the leaves it touches, cuts the new text into pre-tokens from one leaf before the edit (its boundary
context) until a cut falls on an old one behind the edit, encodes only those, and updates the sums above them. Pre-tokens depend on nothing
before their start and at most on one character behind them, so the counts are those of a full encoding.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from samewise.llm.words import record_batch, slices

#: Pre-tokens in a leaf block of the tree.
BLOCK = 32
REMEMBERED = 500_000
Edit = tuple[int, int, str]
#: Personal data and secrets, and what stands in their place.
REDACTIONS = (
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"(?:\+\d+ )?\(\d{3}\) \d{3}-\d{4}", "<phone>"),
    (r"\b[0-9a-fA-F]{32,}\b", "<secret>"),
    (r"\b\d{12,}\b", "<number>"),
)
_REDACT = regex.compile("|".join(f"({p})" for p, _ in REDACTIONS))


def redactions(text: str) -> list[Edit]:
    """Edits (start, end, new text) that take personal data out, in order."""
    return [(m.start(), m.end(), REDACTIONS[m.lastindex - 1][1]) for m in _REDACT.finditer(text)]


class Counter(dict):
    """Tokens of pre-tokens, each different one encoded once (up to a bound)."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.core = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(pattern)
        super().__init__()

    def __missing__(self, part: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[part] = len(self.core.encode_single_piece(part.encode("utf-8", "replace")))
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pattern.findall(text)))


class TokenTree:
    """A document with the number of its tokens, kept through edits."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        parts = counter.pattern.findall(text)
        self.blocks = [parts[i : i + BLOCK] for i in range(0, len(parts), BLOCK)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, block in enumerate(self.blocks):
            self.chars[self.size + i] = sum(map(len, block))
            self.tokens[self.size + i] = sum(map(counter.__getitem__, block))
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, block: int, parts: list[str]) -> None:
        self.blocks[block] = parts
        i = self.size + block
        self.chars[i], self.tokens[i] = sum(map(len, parts)), sum(map(self.counter.__getitem__, parts))
        while i := i // 2:
            self._sum(i)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int]:
        """The block that holds the character at place (the last one, at the end) and where it begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if place - begin >= self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.size, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts new in place of text[start:end]."""
        block, at = self._find(max(0, start - 1))
        # one pre-token of context before the one that holds the character before the edit
        cut = [at]
        for part in self.blocks[block]:
            cut.append(cut[-1] + len(part))
        inside = max(k for k in range(len(cut)) if cut[k] <= max(0, start - 1)) if start else 0
        keep = max(0, inside - 1)
        if not keep and block and inside <= 1:
            before = block - 1
            while before and not self.blocks[before]:
                before -= 1
            if self.blocks[before]:
                at -= self.chars[self.size + before]
                block = before
                keep = len(self.blocks[before]) - 1
                cut = [at]
                for part in self.blocks[block]:
                    cut.append(cut[-1] + len(part))
        origin = cut[keep]
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # old cuts behind the edit, by block
        old_block, old_at, old_part = block, cut[keep], keep
        parts: list[str] = []
        old = old_at
        for m in self.counter.pattern.finditer(self.text, origin):
            parts.append(m.group())
            place = m.end() - shift
            while old < max(end, place) and old_block < len(self.blocks):
                row = self.blocks[old_block]
                if old_part >= len(row):
                    old_block, old_part = old_block + 1, 0
                    continue
                old += len(row[old_part])
                old_part += 1
            if m.end() >= start + len(new) and old == place:
                break
        else:
            old_block, old_part = len(self.blocks), 0
        self.encoded += len(parts)
        rest = self.blocks[old_block][old_part:] if old_block < len(self.blocks) else []
        self._set(block, self.blocks[block][:keep] + parts + rest)
        for b in range(block + 1, min(old_block + 1, len(self.blocks))):
            self._set(b, [])


def token_counts(docs: DataFrame, path: str, pattern: str, edits: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_encoded) for each row of docs (doc_id, text).

    edits gives each text's edits, in order and without overlaps; n_encoded counts the pre-tokens that were encoded again
    for them. A text without edits needs no tree (on the test tables 19 of 20) and is counted by one pass over the same pre-tokens.

    A row for each row of docs, by its text alone: repeated rows and rows without doc_id are counted like others, null and empty texts
    have no tokens, further columns don't matter, and an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for table in slices(batches):
            rows = []
            for text in table["text"].to_pylist():
                text = text or ""
                todo = edits(text)
                if not todo:
                    n = counter.count(text)
                    rows.append((n, 0, n, 0))
                    continue
                tree = TokenTree(text, counter)
                n = tree.total
                for start, end, new in reversed(todo):
                    tree.edit(start, end, new)
                rows.append((n, len(todo), tree.total, tree.encoded))
            yield record_batch(["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"], [table["doc_id"].cast(pa.int64()).combine_chunks(), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_encoded long")
