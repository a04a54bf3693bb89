"""String similarities: built-in expressions, and Arrow-batched kernels for what Spark has no function for."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_overlap(x: Column, y: Column) -> Column:
    """Longest beginning of one text that the other holds."""
    return _overlap(x, y, F.left)


def suffix_overlap(x: Column, y: Column) -> Column:
    return _overlap(x, y, F.right)


def _overlap(x: Column, y: Column, part: Callable[[Column, Column], Column]) -> Column:
    m = F.least(F.length(x), F.length(y))
    held = F.filter(F.sequence(F.lit(1), m), lambda n: F.contains(x, part(y, n)) | F.contains(y, part(x, n)))
    return F.when(m > 0, F.size(held)).otherwise(0)


def begins_inside(x: Column, y: Column, n: int = 4) -> Column:
    """1 if the first n characters of one text are inside the other; 0 for shorter texts."""
    return F.when((F.length(x) >= n) & (F.length(y) >= n) & (F.contains(x, F.left(y, F.lit(n))) | F.contains(y, F.left(x, F.lit(n)))), 1).otherwise(0)


def common_substring(x: Column, y: Column) -> Column:
    """Length of the longest common substring, for short texts: the longest of the parts of x that y holds."""
    lengths = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.aggregate(F.sequence(i, F.length(x)), F.lit(0), lambda best, j: F.when(F.contains(y, F.substring(x, i, j - i + 1)), F.greatest(best, (j - i + 1).cast("int"))).otherwise(best)))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), F.array_max(lengths)).otherwise(0)


def may_share(x: Column, y: Column, n: Column) -> Column:
    """Whether texts can have a common substring of n > 0 characters: y must hold one of the consecutive parts of x of (n + 1) / 2, as n characters cover one."""
    part = F.floor((n + 1) / 2).cast("int")
    held = F.exists(F.sequence(F.lit(0), F.floor(F.length(x) / part).cast("int") - 1), lambda i: F.contains(y, F.substring(x, i * part + 1, part)))
    return F.when((n > 0) & (F.length(x) >= n) & (F.length(y) >= n), held).otherwise(False)


def mean_length_ratio(n: Column, x: Column, y: Column) -> Column:
    total = F.length(x) + F.length(y)
    return F.when(total > 0, 2 * n / total).otherwise(F.lit(0.0))


def where_both(x: Column, y: Column, value: Column) -> Column:
    """value where both texts have characters, else null."""
    return F.when((x != "") & (y != ""), value)


def edit_share(x: Column, y: Column) -> Column:
    """Levenshtein distance over the longer length; null if a text is empty."""
    return where_both(x, y, F.levenshtein(F.lower(x), F.lower(y)) / F.greatest(F.length(x), F.length(y)))


def length_share(x: Column, y: Column) -> Column:
    return where_both(x, y, F.abs(F.length(x) - F.length(y)) / F.greatest(F.length(x), F.length(y)))


def included(x: Column, y: Column) -> Column:
    a, b = F.lower(x), F.lower(y)
    return where_both(x, y, (F.contains(a, b) | F.contains(b, a)).cast("int"))


def equal(x: Column, y: Column) -> Column:
    return where_both(x, y, (F.lower(x) == F.lower(y)).cast("int"))


def same_beginning(x: Column, y: Column, n: int) -> Column:
    return ((F.length(x) >= n) & (F.left(x, F.lit(n)) == F.left(y, F.lit(n)))).cast("int")


def missing(x: Column, y: Column) -> Column:
    return (F.coalesce(x, F.lit("")) == "").cast("int") + (F.coalesce(y, F.lit("")) == "").cast("int")


def shared_elements(a: Column, b: Column) -> tuple[Column, Column]:
    """2c - n1 - n2 and that over n1 + n2 - c, with c the elements of a (each time) that b has."""
    c = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    n = F.size(a) + F.size(b)
    return 2 * c - n, F.when(n - c > 0, (2 * c - n) / (n - c)).otherwise(F.lit(0.0))


def number_agreement(a: Column, b: Column) -> Column:
    """3 equal, 2 one within the other, 1 overlapping, -2 apart, -1 one side without numbers, 0 both."""
    inside = lambda x, y: F.forall(x, lambda n: F.array_contains(y, n))
    none = lambda x: F.size(x) == 0
    return F.when(none(a) & none(b), 0).when(none(a) | none(b), -1).when(a == b, 3).when(inside(a, b) | inside(b, a), 2).when(F.arrays_overlap(a, b), 1).otherwise(-2)


def keyword_hits(c: Column, words: list[str]) -> Column:
    return F.array(*[F.contains(c, F.lit(w)).cast("int") for w in words])


def hit_cosine(a: Column, b: Column) -> tuple[Column, Column]:
    """Cosine and number of common keywords of two hit vectors; 0 if one has none."""
    both = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0), lambda s, v: s + v)
    n = F.aggregate(a, F.lit(0), lambda s, v: s + v) * F.aggregate(b, F.lit(0), lambda s, v: s + v)
    return F.when(n > 0, both / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0)), both


# kernels over plain strings


def longest_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count() if a else 0


def longest_substring(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, other in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if ch == other else 0
            if row[j] > best:
                best = row[j]
    return best


def common_blocks(a: str, b: str, least: int) -> tuple[int, int]:
    """How many longest common blocks of at least `least` characters can be taken out one after another, and their length together."""
    n = total = 0
    while n < 100:
        i, j, size = difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b))
        if size < least or not size:
            break
        a, b, n, total = a[:i] + a[i + size :], b[:j] + b[j + size :], n + 1, total + size
    return n, total


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, with up to four equal first characters counted in where it is above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a part of the longer one of its length, 0 to 100."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0.0
    starts = {max(0, min(len(long_) - len(short), j - i)) for i, j, n in difflib.SequenceMatcher(None, short, long_, False).get_matching_blocks()}
    return 100 * max(difflib.SequenceMatcher(None, short, long_[s : s + len(short)], False).ratio() for s in starts)


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain ratio and of sorted and shared words (at 0.95), with partial forms for texts of very different lengths, 0 to 100."""
    a, b = a.lower().strip(), b.lower().strip()
    if not a or not b:
        return 0.0
    whole = lambda x, y: 100 * difflib.SequenceMatcher(None, x, y, False).ratio()
    x, y = sorted(a.split()), sorted(b.split())
    shared = " ".join(sorted(set(x) & set(y)))
    rest = [" ".join([shared, *sorted(set(p) - set(q))]).strip() for p, q in ((x, y), (y, x))]
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(whole(a, b), 0.95 * whole(" ".join(x), " ".join(y)), 0.95 * max(whole(shared, rest[0]) if shared else 0, whole(shared, rest[1]) if shared else 0, whole(*rest)))
    scale = 0.9 if longer < 8 else 0.6
    return max(whole(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_ratio(" ".join(x), " ".join(y)), 0.95 * scale * (100.0 if shared else partial_ratio(*rest)))


def kernel(kind: str, function: Callable) -> Callable[[Column, Column], Column]:
    """An Arrow-batched Column function of two texts (null: empty); equal pairs of a batch are computed once."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = function(*pair)
            out.append(known[pair])
        return pd.Series(out)

    return run


def all_kernels(a: Column, b: Column) -> Column:
    """All kernels of a text column in one crossing to Python, as a struct."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    names = {"lcs": IntegerType(), "lcs2": IntegerType(), "blocks": IntegerType(), "block_length": IntegerType(), "jaro_winkler": DoubleType(), "ratio": DoubleType()}

    @F.pandas_udf(StructType([StructField(n, t) for n, t in names.items()]))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for pair in zip(x.fillna(""), y.fillna(""), strict=True):
            if pair not in known:
                known[pair] = (longest_subsequence(*pair), longest_substring(*pair), common_blocks(*pair, 4)[0], common_blocks(*pair, 5)[1], jaro_winkler(*pair), sequence_ratio(*pair))
            rows.append(known[pair])
        return pd.DataFrame(rows, columns=list(names))

    return run(a, b)
