import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from samewise.llm import minhash_dedup
from samewise.llm.embedding_dedup import embedding_links
from samewise.llm.minhash_dedup import LIKELY, blocked, dart_minhash, exact_forest, likely_forest, near_duplicates
from samewise.llm.words import mix


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    names = mix(np.arange(400, dtype=np.uint64), 3)
    w = [rng.integers(1, 6, 400).astype(float) * (rng.random(400) < 0.8) for _ in range(2)]
    sets = np.concatenate([np.full(int((x > 0).sum()), i) for i, x in enumerate(w)])
    ranks = dart_minhash(np.concatenate([names[x > 0] for x in w]), np.concatenate([x[x > 0] for x in w]), sets, 3, 1500)
    true = np.minimum(*w).sum() / np.maximum(*w).sum()
    assert abs((ranks[0] == ranks[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 1500)
    assert np.isfinite(ranks[:2]).all() and np.isinf(ranks[2]).all()


@pytest.mark.parametrize("size", [1, 3, 50, 5000])
def test_signatures_of_sets_of_any_size(size):
    names = mix(np.arange(2 * size, dtype=np.uint64), 3)
    part = max(1, int(size * 0.9))
    e = np.concatenate([names[:size], names[:part]])
    ranks = dart_minhash(e, np.ones(len(e)), np.repeat([0, 1], [size, part]), 2, 600)
    assert np.isfinite(ranks).all() and abs((ranks[0] == ranks[1]).mean() - part / size) < 0.08


def parts_of(rows, columns, step):
    """Arrow batches of so many rows, with the columns' types."""
    names, kinds = zip(*columns.items(), strict=True)
    return [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + step]], k) for i, k in enumerate(kinds)], names=list(names)) for at in range(0, len(rows), step)]


def edges_of(batches):
    return [e for b in batches for e in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]


def test_forest_ties_what_is_likely():
    rng = np.random.default_rng(2)
    rows, want, forest_rows = [], set(), 0
    for key in range(40):
        n = int(rng.integers(1, 60))
        base = rng.integers(0, 256, (3, 120))
        group = np.array([np.where(rng.random(120) < rng.choice([0.1, 0.25, 0.4]), rng.integers(0, 256, 120), base[rng.integers(0, 3)]) for _ in range(n)], np.uint8)
        links = [(i, j) for i, j in itertools.combinations(range(n), 2) if (group[i] == group[j]).sum() >= LIKELY * 120]
        classes = union_find(n, links)
        want |= {(100 * key + i, 100 * key + c) for i, c in enumerate(classes)}
        forest_rows += n - len(set(classes))
        rows += [(key, 0, 100 * key + i, group[i].tobytes()) for i in range(n)]
    for step in (7, 1000):
        edges = edges_of(likely_forest(iter(parts_of(rows, {"key": pa.int64(), "salt": pa.int64(), "id": pa.int64(), "coarse": pa.binary()}, step))))
        parent = union_find(4000, edges)
        assert {(r[2], parent[r[2]]) for r in rows} == want and len(edges) == forest_rows


def test_exact_forest_matches_brute_force():
    rng = np.random.default_rng(4)
    rows, want = [], []
    for key in range(30):
        base = rng.integers(0, 5000, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.0, 0.05, 0.12, 0.3]), rng.integers(0, 5000, 60), base)).astype(np.uint32) for _ in range(int(rng.integers(1, 40)))]
        block = rng.integers(0, 2, len(sets)) if key % 2 else np.zeros(len(sets), int)
        for i, j in itertools.combinations(range(len(sets)), 2):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and (block[i] != block[j] or not block.any()):
                want.append((100 * key + i, 100 * key + j))
        rows += [(key, 1, int(block[i]), 100 * key + i, x.tobytes()) for i, x in enumerate(sets)]
    kinds = {"key": pa.int64(), "salt": pa.int64(), "block": pa.int64(), "id": pa.int64(), "shingles": pa.binary()}
    for step in (11, 1000):
        edges = edges_of(exact_forest(0.8)(iter(parts_of(rows, kinds, step))))
        assert set(edges) <= set(want) and union_find(3000, edges) == union_find(3000, want) and len(edges) < len(want)


def near_corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 8)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(5, 200))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            texts.append(" ".join(word() if rnd.random() < rnd.choice([0, 0.01, 0.04]) else w for w in base))
    hot = [word() for _ in range(120)]
    texts += [" ".join(word() if rnd.random() < 0.012 else w for w in hot) for _ in range(90)]
    texts += ["a b c", "a b c", "", None, "the " * 500, "the " * 600, " ".join(word() for _ in range(9000))]
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = near_corpus()
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = union_find(len(texts), links)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(6)
    rows = near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(want))
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == sorted(set(want))


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def two_groups(rnd, q, r):
    """Near copies of Q and of R, each with nearer ones in its own group; only the first of Q and the first of R are at 0.8."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    base, head = [word() for _ in range(204)], [[word(), word()] for _ in range(2)]
    ends = [base[:-21] + [word() for _ in range(21)] for _ in range(2)]
    groups = [[e] + [h + e[2:-1] + [word()] for _ in range(n)] for e, h, n in zip(ends, head, (q, r), strict=True)]
    texts = [[" ".join(w) for w in g] for g in groups]
    assert jaccard(texts[0][0], texts[1][0]) >= 0.8 > max(jaccard(texts[0][0], texts[1][1]), jaccard(texts[0][1], texts[1][0]), jaccard(texts[0][1], texts[1][1]))
    return texts[0] + texts[1]


def test_groups_in_one_bucket_are_linked_by_a_single_pair(spark):
    rnd = random.Random(12)
    texts = [(t, n) for n in range(8) for t in two_groups(rnd, 12, 7)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == {i: n * 21 for i, (_, n) in enumerate(texts)}


@pytest.mark.parametrize("block,shingles,group", [(16, 1 << 22, 1 << 16), (4096, 2000, 1 << 16), (4096, 1 << 22, 10), (16, 2000, 10)])
def test_blocks_of_large_buckets_and_groups_are_compared(spark, monkeypatch, block, shingles, group):
    for name, value in (("BLOCK", block), ("BLOCK_SHINGLES", shingles), ("GROUP", group)):
        monkeypatch.setattr(minhash_dedup, name, value)
    rnd = random.Random(13)
    texts = [(t, n) for n in range(4) for t in two_groups(rnd, 40, 40)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == {i: n * 82 for i, (_, n) in enumerate(texts)}


def test_halves_of_a_large_group_tied_by_one_pair(spark):
    texts = two_groups(random.Random(14), 1700, 1700)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 3402 and {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_blocks_hold_each_pair_once(spark):
    members = [(k, 1000 * k + i, s) for k, sizes in ((1, [1] * 39), (2, [900, 20, 20, 20]), (3, [1, 1]), (4, [1]), (5, [30] * 25)) for i, s in enumerate(sizes)]
    parts = {}
    for r in blocked(spark.createDataFrame(members, "key long, id long, size long"), 10, 300).collect():
        parts.setdefault((r["key"], r["salt"]), []).append((r["id"], r["block"]))
    met = [frozenset((x[0], y[0])) for rows in parts.values() for x, y in itertools.combinations(rows, 2) if x[1] != y[1] or len({b for _, b in rows}) == 1 and x[1] == y[1]]
    want = {frozenset((a[1], b[1])) for a, b in itertools.combinations(members, 2) if a[0] == b[0]}
    assert set(met) == want and all(len(rows) < 40 for rows in parts.values())


def test_weighted_near_duplicates_match_brute_force(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    texts = []
    for _ in range(30):
        line = [word() for _ in range(8)]
        base = [word() for _ in range(60)]
        for _ in range(4):  # the same different shingles, more or less often
            texts.append(" ".join(base + line * rnd.choice([2, 3, 4, 9, 14])))
    counts = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    same = lambda a, b: (a & b).total() >= 0.8 * (a | b).total()
    want = union_find(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if same(counts[i], counts[j])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df, weighted=True).collect()}
    assert got == dict(enumerate(want))
    assert len(set(want)) > len({r["class_id"] for r in near_duplicates(df).collect()})


def test_rows_of_one_id_with_other_texts_are_texts_of_their_own(spark):
    near = lambda a, b: f"{a} " + " ".join(f"w{i}" for i in range(60)) + f" {b}"
    rows = [(7, near("x", "y")), (7, "all other words in this one"), (3, near("x", "z")), (7, near("x", "y")), (9, "all other words in this one")]
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (7, 7, True), (9, 7, False)]


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (2, ""), (9, "x")], "doc_id long, text string")
    rows = near_duplicates(df).collect()
    assert len(rows) == 5 and sum(r["kept"] for r in rows if r["doc_id"] == 5) == 1
    assert near_duplicates(df.where("false")).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(scale=rng.uniform(0.05, 0.6), size=(40, 16)) for c in centres] + [np.repeat(rng.normal(size=(1, 16)), 30, 0)]).astype(np.float32)
    x[5] = x[4] * 3
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [1.0, 2.0], [1e300] + [0.0] * 15]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(None, x[0].tolist(), 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(5)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = np.triu(u @ u.T >= 0.9, 1)
    n = links.sum(0) + links.sum(1)
    want = union_find(len(x), zip(*np.nonzero(links), strict=True))
    for i in range(len(x)):
        assert got[i] == (n[i], want[i], want[i] == i)
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(8)) and got[None][0] == 0
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tasks_hold_one_python_worker(spark, monkeypatch):
    from samewise import session
    from samewise.operators import graph

    plans = []

    def seen(df, *more, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.written(df, *more, **named)

    for module in (graph, minhash_dedup):
        monkeypatch.setattr(module, "written", seen)
    texts = [(i, " ".join(f"w{(i % 9) * 50 + j}" for j in range(40)) + f" end{i % 2}") for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: i % 9 for i in range(40)}
    assert any("MapInArrow" in p for p in plans)
    for plan in plans:  # two functions without an exchange between them are two workers of a task
        for stage in re.split(r"Exchange|Scan |Join", plan):
            assert stage.count("MapInArrow") <= 1, stage
