import random

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from test_scores import plain_score, toxic_corpus
from test_substring import WORD
from samewise.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
# Columns that the operators themselves make, or that a stage names.
CLASHES = ("score", "label_posterior", "predicted", "n_words", "n_removed", "class_id", "kept", "text_hash", "row", "rest", "id", "hash", "nth", "order", "nth_of_document", "score_before", "length", "task", "block", "a.b")


def table(spark, rows, clashes=False):
    """doc_id and text with further columns, which tell each row apart."""
    df = spark.createDataFrame([(i, t, "en", f"s{k}", -1 if t is None else len(t)) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    return df.withColumns({c: F.concat(F.lit(c), "source") for c in CLASHES}) if clashes else df


def told(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) + ("." if k % 9 == 8 else "") for k in range(n))


def odd_rows():
    rnd = random.Random(3)
    long = words(rnd, 60)
    return [(1, long), (1, long), (1, words(rnd, 60)), (2, None), (2, None), (3, ""), (None, long), (None, long), (None, None), (4, long + " other"), (5, words(rnd, 30_000))]


@pytest.fixture
def labels(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_take_odd_rows_empty_tables_and_clashing_columns(spark, labels, name, stage):
    folder = labels([(1, 0), (4, 1), (None, 1), (5, None)])
    docs = table(spark, odd_rows(), clashes=True)
    out = stage(spark, docs, folder)
    if name != "best_fit_packing":
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        before = {r["source"]: r for r in docs.collect()}
        for r in out.collect():
            assert all(r[c] == before[r["source"]][c] for c in docs.columns if c not in ("text", "n_chars"))
    else:
        assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5, None}
    empty = stage(spark, docs.where("false"), folder)
    assert empty.count() == 0 and empty.columns == out.columns
    bare = stage(spark, table(spark, odd_rows()).select("doc_id", "text"), folder)
    assert bare.count() >= 0 and (name == "best_fit_packing" or bare.columns == ["doc_id", "text"])


def test_toxic_documents_go(spark, labels):
    import zlib

    corpus = [(i, x + " zorg" * (i % 17 == 3), y) for i, x, y in toxic_corpus(240)]
    rows = [(i, x) for i, x, _ in corpus] + [(None, "zorg zorg zorg qwixen " * 3), (7, corpus[7][1]), (300, None), (301, "")]
    folder = labels([(i, y) for i, _, y in corpus if i % 3])
    learnt = {i: y for i, _, y in corpus if i % 3 and zlib.crc32(str(i).encode()) % 5}
    unique = {k: t for k, (_, t) in enumerate(rows)}
    # rows of one id and text count as often as they stand there
    by_row = {k: learnt[i] for k, (i, _) in enumerate(rows) if i in learnt}
    want = plain_score(unique, by_row)
    got = told(pipeline.drop_toxic(spark, table(spark, rows), folder))
    assert got == sorted(((i, t, f"s{k}") for k, (i, t) in enumerate(rows) if want[k] < 0.5), key=str)
    assert 0 < len(got) < len(rows) and (300, None, "s242") in got


def plain_quality(texts):
    """Scores of the quality model, text by text, from the texts alone."""
    def measure(text):
        raw = (text or "").encode()
        ws = [w.encode() for w in WORD.findall(text or "")]
        n, solid = max(1, len(ws)), [b for b in raw if b not in (32, 9, 10, 11, 12, 13)]
        sign = lambda b: b < 128 and not chr(b).isalnum()
        some = max(1, len(solid))
        latin = [b for b in raw if chr(b).isascii() and chr(b).isalpha()]
        return {
            "repeated_next": sum(a == b for a, b in zip(ws, ws[1:])) / n,
            "distinct": len(set(ws)) / n if len(ws) >= 40 else 1.0,
            "noisy_signs": sum(sum(map(sign, w)) >= 2 for w in ws) / n,
            "upper": sum(65 <= b <= 90 for b in raw) / max(1, len(latin)),
            "bars": sum(w == b"|" for w in ws) / n,
            "signs": sum(map(sign, solid)) / some,
            "letters": sum(b >= 0xC3 or chr(b).isascii() and chr(b).isalpha() for b in raw) / some,
            "word_length": some / n,
            "sentence_ends": sum(w[-1:] in (b".", b"?", b"!") for w in ws) / n if len(ws) >= 20 else 0.1,
            "words": len(ws),
        }, ws

    def vote(name, x):
        _, below, above, low, high = next(row for row in q.LABELLERS if row[0] == name)
        return 2 if low <= x <= high else 0 if x < below or x > above else 1

    measured = [measure(t) for t in texts]
    v = np.array([[vote(name, m[name]) for name, *_ in q.LABELLERS] for m, _ in measured])
    total, k = len(texts), len(q.LABELLERS)
    # classes: good, and bad for each labeller's reason; each document is one row
    prior = np.full((k + 1, k, 3), [0.5, 0.5, 2.0])
    for j in range(k):
        prior[1 + j, j] = np.array([0.9, 0.07, 0.03]) * (10 + 0.05 * total)
    odds = prior / prior.sum(2, keepdims=True)
    odds[0] = [q.FALSE_ALARMS, 0.2, 0.8 - q.FALSE_ALARMS]
    shares = np.array([0.85] + [0.15 / k] * k)

    def classes():
        p = np.array([[shares[c] * np.prod([odds[c, j, row[j]] for j in range(k)]) for c in range(k + 1)] for row in v])
        return p / p.sum(1, keepdims=True)

    for _ in range(200):
        p, was = classes(), odds
        odds = np.array([[[prior[c, j, w] + p[v[:, j] == w, c].sum() for w in range(3)] for j in range(k)] for c in range(k + 1)])
        odds /= odds.sum(2, keepdims=True)
        for j in range(k):
            bad = (p[v[:, j] == 0, 0].sum() + q.FALSE_ALARMS * total / 2) / (p[:, 0].sum() + total / 2)
            odds[0, j] *= (1 - bad) / (1 - odds[0, j, 0])
            odds[0, j, 0] = bad
        shares = (p.sum(0) + 1) / (p.sum() + k + 1)
        if abs(odds - was).max() < 1e-7:
            break
    good = classes()[:, 0]

    def hashed(part, seed):
        return int(q.mix(q.word_hashes(np.frombuffer(part + b"\0", np.uint8), np.array([0]), np.array([len(part)])), seed)[0] % np.uint64(q.BUCKETS))

    def features(m, ws):
        out = {}
        for w in ws:
            for part, seed in ((w[:3], 61), (w[-2:], 62)):
                out[hashed(part, seed)] = out.get(hashed(part, seed), 0.0) + 1 / np.sqrt(len(ws)) / 3
        for j, (name, *_) in enumerate(q.LABELLERS):
            step = int(np.floor(np.log2(max(m[name], 1e-4)) * 2)) + 1000 * (j + 1)
            b = int(q.mix(np.array([step], np.int64).astype(np.uint64), 63)[0] % np.uint64(q.BUCKETS))
            out[b] = out.get(b, 0.0) + 1.0
        return out

    return good, [features(m, ws) for m, ws in measured]


def test_quality_matches_a_plain_version(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(160):
        kind = i % 8
        ws = words(rnd, rnd.randint(40, 90)).split()
        rows.append((i, " ".join(w.upper() + "!!" for w in ws) if kind == 0 else " ".join(w for w in ws[:6] for _ in range(12)) if kind == 1 else " ".join(ws)))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (3, rows[3][1]), (502, "Ünï cödé | x | y. " * 12)]
    good, feats = plain_quality([t for _, t in rows])
    docs = table(spark, rows)
    hashes = {r["source"]: r["h"] for r in docs.select("source", F.xxhash64("text").alias("h")).collect()}
    # the linear scorer's training: each different text of the sample once, in order of its hash; 0.9 of train_docs / total is over 1 here
    sample = sorted({hashes[f"s{k}"]: k for k in reversed(range(len(rows)))}.items())
    w, squares, bias, rng = np.zeros(q.BUCKETS), np.full(q.BUCKETS, 1e-8), 0.0, np.random.default_rng(5)
    for _ in range(q.EPOCHS):
        for i in rng.permutation(len(sample)):
            k = sample[i][1]
            z = sum(w[b] * x for b, x in feats[k].items()) + bias
            g = 1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) - good[k]
            for b, x in feats[k].items():
                squares[b] += (g * x) ** 2
                w[b] -= 0.3 * g * x / np.sqrt(squares[b])
            bias -= 0.02 * g
    score = [1 / (1 + np.exp(-(sum(w[b] * x for b, x in f.items()) + bias))) for f in feats]
    scored = {r["source"]: r for r in q.quality(docs, q.fit(docs)).collect()}
    assert max(abs(scored[f"s{k}"]["label_posterior"] - good[k]) for k in range(len(rows))) < 1e-4
    assert max(abs(scored[f"s{k}"]["score"] - score[k]) for k in range(len(rows))) < 1e-2
    got = told(pipeline.drop_poor(spark, docs, ""))
    assert got == sorted(((i, t, f"s{k}") for k, (i, t) in enumerate(rows) if score[k] >= 0.5), key=str) and 100 < len(got) < 150


def test_one_document_of_each_class_stays(spark):
    rnd = random.Random(8)
    base = [words(rnd, 80) for _ in range(6)]
    near = lambda t: t + " end"
    rows = [(10, base[0]), (4, near(base[0])), (10, base[1]), (10, base[1]), (11, base[1]), (7, base[2]), (7, base[3]), (8, near(base[3])), (20, ""), (20, ""), (21, None), (None, base[0]), (None, base[0]), (3, base[4]), (3, near(base[4]))]
    got = told(pipeline.one_of_each(spark, table(spark, rows), ""))
    ids = sorted([(r[0], r[1]) for r in got], key=str)
    low = min((base[4], near(base[4])), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])  # of one class and one id
    assert ids == sorted([(4, near(base[0])), (10, base[1]), (7, base[2]), (7, base[3]), (20, ""), (21, None), (None, base[0]), (None, base[0]), (3, low)], key=str)


def plain_passages(rows, window=13):
    first = {}
    for i, t in rows:
        ws = WORD.findall(t or "")
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        ws, gone = WORD.findall(t or ""), set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (1 << 62 if i is None else i):
                gone |= set(range(k, k + window))
        out.append(" ".join(w for k, w in enumerate(ws) if k not in gone) if gone else t)
    return out


def test_repeated_passages_go(spark):
    rnd = random.Random(9)
    passage = words(rnd, 55)
    rows = [(i, f"{words(rnd, 20)}  {passage if i % 3 == 0 else ''}\n{words(rnd, 15)}") for i in range(30)] + [(0, passage), (None, passage), (50, None), (51, ""), (3, passage + " x"), (3, passage + " y")]
    df = pipeline.drop_repeated_passages(spark, table(spark, rows), "")
    assert told(df) == sorted(((i, t, f"s{k}") for k, ((i, _), t) in enumerate(zip(rows, plain_passages(rows), strict=True))), key=str)
    assert all(r["n_chars"] == (-1 if r["text"] is None else len(r["text"])) for r in df.collect())


def test_run_applies_all_stages(spark, tmp_path):
    corpus = [(i, x + " " + words(random.Random(i), 30), y) for i, x, y in toxic_corpus(200)]
    rows = [(i, x) for i, x, _ in corpus] + [(300 + i, x + " again") for i, x, _ in corpus[:40]] + [(None, "no id " + corpus[1][1]), (400, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = told(pipeline.drop_toxic(spark, docs, str(tmp_path)))
    step = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in kept], SCHEMA)
    kept = told(pipeline.drop_poor(spark, step, str(tmp_path)))
    step = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in kept], SCHEMA)
    kept = told(pipeline.one_of_each(spark, step, str(tmp_path)))
    texts = plain_passages([(i, t) for i, t, _ in kept])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for (i, _, _), t in zip(kept, texts, strict=True))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == want and 50 < len(want) < len(rows)
