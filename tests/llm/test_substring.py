import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from samewise.llm import substring_dedup as op
from samewise.llm.fmindex import FMIndex, PackedBits, WaveletMatrix
from samewise.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_dedup(rows, window=13):
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        ws, gone = WORD.findall(t or ""), set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (2**63 - 1 if i is None else i):
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(n=120, seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "a", "é"]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 14)))
    passage = [word() for _ in range(40)]
    rows = [(0, ""), (1, None), (2, "   \n\t "), (3, "be " * 900), (4, "be " * 400 + "x"), (5, " ".join(passage))]
    for i in range(6, n):
        ws = [word() for _ in range(rnd.randint(1, 80))]
        if rnd.random() < 0.6:
            a = rnd.randint(0, 20)
            at = rnd.randint(0, len(ws))
            ws[at:at] = passage[a : a + rnd.randint(5, 40)]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(ws)))
    rows += [(rnd.randint(0, 40), rows[k][1]) for k in range(6, 14)] + [(None, rows[20][1]), (None, rows[20][1]), (7, rows[7][1]), (n, " ".join([word() for _ in range(20000)] + passage))]
    rnd.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("n_words", F.lit("x"))
    assert result(substring_dedup(df.repartition(5), digest=True)) == plain_dedup(rows)


def test_frequent_anchors_send_single_passages(spark, monkeypatch):
    rows = corpus(60, 2)
    monkeypatch.setattr(op, "FREQUENT", 1)
    import pyarrow as pa

    w = op.Words(pa.array([t for _, t in rows]))
    places, anchor = op.anchors(w, 13, 5)
    known = pa.table({"a": np.unique(anchor), "many": np.ones(len(np.unique(anchor)), bool)})
    start, size, content, dealt = op._candidates(w, known, 13, 5)
    assert (size == 1).all() and (content == dealt).all() and sorted(start) == sorted(places)


def test_small_shards_and_blocks_change_nothing(spark):
    """What a corpus a thousand times larger would look like to a shard and to a block."""
    rows = corpus(90, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(substring_dedup(df, digest=True, shard_bytes=300, block_bytes=700)) == plain_dedup(rows)


def test_index_is_compressed():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(0, rng.integers(1, 2000, 60)) for _ in range(2000)] * 3 + [[0]])
    index = FMIndex(text, 2000, 13)
    assert index.n_bytes < 8 * len(text)  # 11 bits a word, two bits for groups, their counts, and a start for each near group


def test_empty_table_and_text_output(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    out = substring_dedup(empty)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "n_removed"] and out.count() == 0
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, "\n".join(words), "a"), (2, "new " + " ".join(words) + "  end", "b")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["text"], r["lang"], r["n_removed"]) for r in substring_dedup(df).collect()}
    assert got == {1: ("\n".join(words), "a", 0), 2: ("new end", "b", 30)}


def test_rank_structures():
    rng = np.random.default_rng(0)
    bits = rng.random(1000) < 0.3
    at = np.arange(1001)
    assert (PackedBits(bits).rank(at) == np.append(0, np.cumsum(bits))).all()
    text = rng.integers(0, 37, 500)
    tree = WaveletMatrix(text, 37)
    for s in range(37):
        assert (tree.rank(np.full(501, s), np.arange(501)) == np.append(0, np.cumsum(text == s))).all()


def test_index_finds_windows_of_foreign_sequences():
    rng = np.random.default_rng(4)
    text = np.concatenate([[0], rng.integers(1, 5, 400), [0], rng.integers(1, 5, 300), [0]])
    index = FMIndex(text, 6, 6, np.arange(len(text)))
    query = rng.integers(1, 6, 500)
    _, place, group = index.windows(query, np.array([0]), np.array([500]))
    have = {tuple(text[i : i + 6]) for i in range(len(text) - 5)}
    assert sorted(place) == [i for i in range(495) if tuple(query[i : i + 6]) in have]
    first = {}
    for i in range(len(text) - 5):
        first.setdefault(tuple(text[i : i + 6]), i)
    assert all(index.least[g] == first[tuple(query[p : p + 6])] for p, g in zip(place, group, strict=True))
