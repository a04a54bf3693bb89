import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from samewise.llm import packing
from samewise.llm.packing import OpenBins, WordBpe, WordCache, best_fit_packing, plan
from samewise.llm.words import Words

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World's best café!", "ÀÉ İstanbul ΟΔΥΣΣΕΎΣ  x́y", "a<|endoftext|>b <|startoftext|>", "日本語 テスト 12³4", "\x7f\x00 z", "it's we'll O'Re", "  \n\t ", "long " * 9000, "émoji😀!!??", "x" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    flat, bounds = WordCache(WordBpe(PATH)).ids(Words(pa.array(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 1000])
    lengths = [rnd.randint(1, capacity) if rnd.random() < 0.7 else capacity // 3 for _ in range(600)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = plan(counts, capacity)
    used = {}
    for k, (n, rank, first, each, at) in enumerate(rows):
        stop = min([r[1] for r in rows[k + 1 :] if r[0] == n] + [counts[n]])
        for r in range(stop - rank):
            used.setdefault(first + r // each, []).append((at + n * (r % each), n))
    assert sum(map(len, used.values())) == len(lengths)
    for pieces in used.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(pieces[-1]) <= capacity
    left, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(left, n)
        if i < len(left):
            room = left.pop(i)
        else:
            room, bins = capacity, bins + 1
        if room > n:
            bisect.insort(left, room - n)
    assert len(used) == bins


def test_tightest_bin():
    bins = OpenBins(100)
    for room in (7, 30, 99):
        bins.put(room, room, 1)
    assert [bins.tightest(n) for n in (1, 7, 8, 31, 100)] == [7, 7, 30, 99, 0]
    bins.take(30, 1)
    assert bins.tightest(8) == 99


@pytest.mark.parametrize("tasks_of_a_range", [1024, 2])
def test_pieces_cover_documents(spark, tokenizer, monkeypatch, tasks_of_a_range):
    monkeypatch.setattr(packing, "RANGE", tasks_of_a_range)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string").repartition(7)
    got = best_fit_packing(df, PATH).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(pieces[-1]) <= 4096
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
