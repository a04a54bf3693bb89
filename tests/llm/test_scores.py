import itertools
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from samewise.llm import minhash_dedup
from samewise.llm import quality as q
from samewise.llm import toxicity as t
from samewise.llm.words import Words


def test_maximal_segments():
    rnd = random.Random(1)

    def plain(scores):
        """Take the best segment (the shortest, leftmost of equals), then go on left and right of it."""
        found = []

        def go(a, b):
            best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return
            found.append((best[3], best[4], best[0]))
            go(a, best[3])
            go(best[4], b)

        go(0, len(scores))
        return sorted(found)

    for _ in range(60):
        scores = [rnd.randint(-50, 40) / 8 + rnd.random() / 1000 for _ in range(rnd.randint(0, 25))]
        got = sorted(t.maximal_segments(scores))
        want = plain(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_maximal_segments_are_found_in_linear_time():
    rnd = random.Random(3)
    falling = [rnd.choice([1.0, 2.0]) if i % 2 else -2.5 for i in range(1_000_000)]
    start = time.perf_counter()
    assert len(t.maximal_segments(falling)) == 500_000
    assert time.perf_counter() - start < 20


def toxic_corpus(n=900):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    common = [word() for _ in range(80)]
    rows = []
    for i in range(n):
        ws = [rnd.choice(common) if rnd.random() < 0.7 else word() for _ in range(rnd.randint(3, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                ws.insert(rnd.randint(0, len(ws)), rnd.choice(["Zorg!", "zorg", "qwixen", "qwixal", "qwix" + word()]))
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_toxicity_learns_words_and_stems(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, x, "s") for i, x, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in t.toxicity(docs.select("doc_id", "text"), model).collect()}
    held = [(y, scored[i] >= 0.5) for i, _, y in rows if i >= 600]
    assert np.mean([a == b for a, b in held]) > 0.97
    spans = model.spans(pa.array(["abc " * 30 + "zorg, qwixon " + "abc " * 30]))[0]
    assert spans and spans[0][0] == 120
    odd = t.toxicity(spark.createDataFrame([(1, None), (2, ""), (3, "abc " * 50000)], "doc_id long, text string"), model).collect()
    assert len(odd) == 3 and all(0 <= r["score"] < 0.5 for r in odd)
    assert t.toxicity(docs.where("false").select("doc_id", "text"), t.fit(docs.where("false"), labels)).count() == 0


def plain_score(docs, labels):
    """The whole score by dictionaries and exhaustive search, for {id: text} and {id: label}."""

    def tokens(text):
        out = []
        for c in text or "":
            if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×"):
                c = c.lower()
            out.append(" " if c < "\x80" and not c.isalnum() else c)
        return "".join(out).split(" ")

    words = {i: [w.encode() for w in tokens(x) if w] for i, x in docs.items()}
    train = [i for i in labels if i in docs]
    share = (sum(labels[i] for i in train) + 0.5) / (len(train) + 1)
    base = math.log(share / (1 - share))
    counts = [{}, {}]
    for i in train:
        for k, names in enumerate(({w for w in words[i]}, {w[:5] for w in words[i]})):
            for w in names:
                counts[k].setdefault(w, [0, 0])[labels[i]] += 1
    start = {b: (n[1] + 20 * share) / (sum(n) + 20) for b, n in counts[1].items()}
    odds = {w: (n[1] + 20 * start[w[:5]]) / (sum(n) + 20) for w, n in counts[0].items()}

    def score(w):
        p = odds.get(w, start.get(w[:5]))
        return -1.5 if p is None else math.log(p / (1 - p)) - base - 1.5

    def segments(i):
        s = [score(w) for w in words[i]]
        sums = [0.0, *itertools.accumulate(s)]
        found, todo = [], [(0, len(s))]
        while todo:
            a, b = todo.pop()
            best = max(((sums[y] - sums[x], x - y, -x, x, y) for x in range(a, b) for y in range(x + 1, b + 1)), default=(0,))
            if best[0] > 0:
                found.append(best[0])
                todo += [(a, best[3]), (best[4], b)]
        return found

    hist = Counter(min(319, int((max(-8, min(8, score(w))) + 8) * 20)) for i in train for w in words[i])
    total = sum(hist.values())
    grow = lambda r: sum(n / total * math.exp(r * (-8 + k * 0.05 + 0.025)) for k, n in hist.items())
    low, high = 1e-6, 1.0
    while grow(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 1 else (low, mid)
    each = {i: segments(i) for i in docs}
    best = [high * max(each[i]) - math.log(len(words[i])) for i in train if not labels[i] and each[i]]
    log_k = sum(best) / len(best) - 0.5772156649015329

    def statistics(i):
        excess = [high * s - log_k - math.log(max(1, len(words[i]))) for s in each[i]]
        return [1.0, min(50, max([0.0, *excess])), min(200, sum(x for x in excess if x > 0))]

    x, y = np.array([statistics(i) for i in train]), np.array([labels[i] for i in train], float)
    w = np.zeros(3)
    for _ in range(400):  # the same ridge, by small steps of Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3), x.T @ (p - y) + 1e-2 * w)
    return {i: 1 / (1 + math.exp(-float(np.dot(statistics(i), w)))) for i in docs}


def test_scores_match_a_plain_version(spark):
    rows = [(i, x + " zorg" * (i % 17 == 3), y) for i, x, y in toxic_corpus(260)]
    docs = {i: x for i, x, _ in rows} | {1000: None, 1001: "", 1002: "ZORG Été, zorg! " * 8}
    labels = {i: y for i, _, y in rows if i % 3}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    model = t.fit(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in t.toxicity(df, model).collect()}
    want = plain_score(docs, labels)
    assert model.calibration.log_k != 0 and got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 2e-3 and got[1000] == got[1001] and got[1002] > 0.5


def test_toxicity_query_learns_from_rows_that_are_not_held_out(spark, tmp_path):
    from samewise.llm.queries import op6_toxicity

    rows = [(None, "zorg of a null id"), *((i, x) for i, x, _ in toxic_corpus(300))]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    spark.createDataFrame([(i, x, 1.0) for i, x in rows], "doc_id long, text string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    results = []
    for n, lie in enumerate((0, 1)):  # labels of held-out rows must not matter
        labels = [(i, (y ^ lie) if out(i) else y, 1) for i, _, y in toxic_corpus(300)] + [(None, 1, 1)]
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.catalog.clearCache()
        results.append({r["doc_id"]: tuple(r)[1:] for r in op6_toxicity(spark, str(tmp_path)).collect()})
        assert n or op6_toxicity(spark, str(tmp_path)).columns == ["doc_id", "held_out", "score", "predicted"]
    assert results[0] == results[1] and len(results[0]) == 301
    for i, (held, score, predicted) in results[0].items():
        assert held == (True if i is None else out(i)) and predicted == int(score >= 0.5) and 0 <= score <= 1


@pytest.mark.parametrize("word", ["zorg ", "abc "])
def test_very_long_texts_are_scored(spark, word):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    model = t.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    rnd = random.Random(1)
    text = " ".join(word if rnd.random() < 0.3 else rnd.choice(rows)[1].split()[0] for _ in range(150_000))
    start = time.perf_counter()
    assert 0 <= t.toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["score"] <= 1
    assert time.perf_counter() - start < 30


def test_label_model_finds_reasons_without_labels():
    rng = np.random.default_rng(3)
    k, n = len(q.LABELLERS), 6000
    good = rng.random(n) < 0.85
    v = np.where(rng.random((n, k)) < 0.85, q.GOOD, q.NONE)
    reason = rng.integers(0, k, n)
    bad = np.flatnonzero(~good)
    v[bad, reason[bad]] = np.where(rng.random(len(bad)) < 0.9, q.BAD, q.NONE)
    v[rng.random((n, k)) < 0.004] = q.BAD
    code, count = np.unique(v @ q.POWERS, return_counts=True)
    model = q.expectation_maximisation(code[:, None] // q.POWERS % 3, count.astype(float))
    p = model.posterior(v) >= 0.5
    assert (p == good).mean() > 0.93 and abs(model.shares[0] - 0.85) < 0.05
    assert (model.accuracies()[:, 0] > 0.7).all() and (model.accuracies()[:, 1] < 0.05).all()


def test_measures_and_votes():
    texts = ["Plain sentences of some words. They go on and on here, with more words than one needs. " * 3, "the the the the the the the the the the " * 6, "AB!! CD!! EF!! GH!! " * 15, "x *** a%% b### c$$$ " * 12, "", None, "one | two | three | four | five | " * 10]
    v = q.votes(q.measures(Words(pa.array(texts))))
    names = [n for n, *_ in q.LABELLERS]
    assert (v[0] != q.BAD).all()
    assert v[1, names.index("repeated_next")] == q.BAD and v[2, names.index("upper")] == q.BAD and v[3, names.index("noisy_signs")] == q.BAD and v[6, names.index("bars")] == q.BAD
    assert (v[4] == v[5]).all() and v[4, names.index("words")] == q.BAD


def test_quality_end_to_end(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(700):
        ws = [word() for _ in range(rnd.randint(40, 120))]
        kind = i % 10
        if kind == 0:
            rows.append((i, " ".join(w.upper() + "!!" for w in ws), 0))
        elif kind == 1:
            rows.append((i, " ".join(w for w in ws[:8] for _ in range(20)), 0))
        else:
            rows.append((i, " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(ws)), 1))
    df = spark.createDataFrame([(i, x, 7) for i, x, _ in rows], "doc_id long, text string, predicted int").repartition(4)
    got = {r["doc_id"]: r["predicted"] for r in q.quality(df, q.fit(df)).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.97
    empty = df.where("false")
    assert q.quality(empty, q.fit(empty)).count() == 0


def test_the_counts_that_toxicity_brings_to_the_driver_are_narrow(spark, monkeypatch):
    rows = toxic_corpus(200)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    width = {"tinyint": 1, "int": 4, "bigint": 8}
    seen, kind = [], type(docs)
    for name in ("toPandas", "toArrow"):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, real=real: seen.append(dict(self.dtypes)) or real(self))
    t.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    counts = [x for x in seen if "slot" in x]
    assert len(counts) == 1 and sum(width[x] for x in counts[0].values()) <= 17


@pytest.mark.parametrize("kernel", ["patterns", "examples", "counts", "greatest", "sketches"])
def test_kernels_hold_little_of_a_large_batch(kernel, monkeypatch):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(5000)]
    n = 4000
    text = [" ".join(rnd.choices(words, k=400)) for _ in range(n)]
    ids = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_pydict({"text": text, "h": ids, "doc_id": ids, "text_hash": ids, "toxic": pa.array([i % 5 == 0 for i in range(n)]).cast(pa.int32())})
    tokens = t.Tokens(np.full(t.WORD_SLOTS, -1.0, np.float32), np.full(t.START_SLOTS, -1.0, np.float32), -1.5)
    labels = q.expectation_maximisation(np.ones((1, len(q.LABELLERS)), int), np.ones(1))
    monkeypatch.setattr(minhash_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    work = {"patterns": q._patterns, "examples": q._examples(labels), "counts": t._counts, "greatest": t._greatest(tokens), "sketches": minhash_dedup.sketches(5, 24, 5, False)}[kernel]
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in work(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows and most < 90e6, most
