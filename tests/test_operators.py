import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from samewise.operators import blocking, cluster, evaluate, tfidf
from samewise.operators.graph import components
from samewise.sources.tables import clipped, first_rows, narrow_types, read_csv, read_json, write_csv
from pyspark.sql.types import ByteType, IntegerType


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(501, 530)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in union_find(edges).items() if any(a != b and k in (a, b) for a, b in edges)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs_and_chains(spark, monkeypatch):
    from samewise.operators import graph

    monkeypatch.setattr(graph, "TASK_EDGES", 50)  # so that tasks see few edges at once
    rnd = random.Random(6)
    edges = [(h, rnd.randint(0, 900)) for h in (450, 3, 899) for _ in range(60)] + [(rnd.randint(0, 900), rnd.randint(0, 900)) for _ in range(200)] + [(950, i) for i in range(951, 990)]
    chain = list(range(2000, 2600))
    rnd.shuffle(chain)
    edges += list(zip(chain, chain[1:])) + [(i, i + 1) for i in range(3000, 3300)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {k: v for k, v in union_find(edges).items() if any(a != b and k in (a, b) for a, b in edges)}
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges[:120]] + [(None, "n1")], "a string, b string")
    got = {r["id"]: r["component"] for r in components(named).collect()}
    assert got == {k: v for k, v in union_find([(f"n{a}", f"n{b}") for a, b in edges[:120]]).items() if any(a != b and k in (f"n{a}", f"n{b}") for a, b in edges[:120])}


def test_canonical_is_idempotent(spark):
    pairs = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (1, 4)], "id_1 long, id_2 long")
    once = blocking.canonical(pairs)
    assert sorted(map(tuple, once.collect())) == [(1, 2), (1, 4)]
    assert sorted(map(tuple, blocking.canonical(once).collect())) == [(1, 2), (1, 4)]


def test_global_rank_and_shifts(spark):
    rows = spark.range(101).withColumn("v", F.col("id") * 37 % 101)
    ranked = blocking.ranked(rows, ["v"], parts=7)
    assert all(r["v"] == r["rank"] for r in ranked.collect())
    pairs = blocking.circular_shifts(ranked, "v", "rank", 101, [1, 5])
    assert {(r["id_1"], r["id_2"]) for r in pairs.collect()} == {(i, (i + s) % 101) for i in range(101) for s in (1, 5)}


def test_cells_over_the_limit_keep_neighbours(spark):
    rows = spark.range(12).withColumn("c", F.when(F.col("id") < 4, 0).otherwise(1))
    got = {tuple(r) for r in blocking.cell_pairs(rows, "id", ["c"], 4).select("id_1", "id_2").collect()}
    assert got == {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(a, b) for a in range(4, 12) for b in range(a + 1, min(12, a + 5))}


def test_radius_counts_and_nearest_match_brute_force(spark):
    rnd = random.Random(2)
    points = [(i, rnd.uniform(-5, 5), rnd.uniform(-5, 5), i % 2) for i in range(60)]
    df = spark.createDataFrame(points, "id long, lat double, lon double, g int")
    got = {r["id"]: (r["n_0"], r["n_1"]) for r in blocking.radius_counts(df, "id", df, "lat", "lon", [0.5, 2.0]).collect()}
    near = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5
    assert got == {a[0]: tuple(sum(near(a, b) <= r for b in points) for r in (0.5, 2.0)) for a in points}
    found = {(r["id_1"], r["id_2"]) for r in blocking.nearest_places(df, "id", "lat", "lon", ["g"], 2, 1.5).collect()}
    want = set()
    for a in points:
        others = sorted((near(a, b), b[0]) for b in points if b[0] != a[0] and b[3] == a[3] and near(a, b) <= 1.5)
        want |= {(a[0], i) for _, i in others[:2]}
    assert found == want


def test_greedy_growth_and_merging():
    pairs = [(1, 2, 0.95), (2, 3, 0.9), (3, 4, 0.8), (5, 6, 0.7), (4, 5, 0.65)]
    grown = cluster.grow(pairs, 0.45, 0.85)
    assert grown == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 4: 5}  # 4 fails at the large cluster, joins the small one
    assert set(cluster.merge(pairs, dict(grown), 0.6, 300).values()) == {1}
    assert cluster.merge(pairs, dict(grown), 0.6, 5) == grown


def test_merging_by_all_scores():
    grown = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}
    pairs = [(1, 3, 0.95), (3, 5, 0.7), (4, 6, 0.6), (5, 7, 0.85), (1, 7, 0.2), (2, 8, 0.3)]
    # 3 to 1 by one score, 5 to where 3 went by a mean of two, 7 by neither
    assert cluster.merge_by_scores(pairs, dict(grown), 0.9, 0.6, 300) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7}
    assert cluster.merge_by_scores(pairs, dict(grown), 0.9, 0.6, 4) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7}
    alone = cluster.without_outliers([(1, 2, 0.9), (2, 3, 0.2), (1, 3, 0.2), (4, 5, 0.1)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}, 0.25)
    assert alone == {1: 1, 2: 1, 3: ("alone", 3), 4: 4, 5: 4}


def test_a_mean_at_the_limit_is_not_below_it(spark):
    scores = [0.06, 0.29, 0.57, 0.08]
    clusters = spark.createDataFrame([(i, "a") for i in range(5)], "id long, cluster string")
    for order in (scores, scores[::-1]):  # as doubles they add up to less than 1 in any order
        df = spark.createDataFrame([(0, i, s) for i, s in enumerate(order, 1)], "id_1 long, id_2 long, score double")
        got = {r["id"]: (r["mean"], r["outlier"]) for r in cluster.outliers(df, clusters, 0.25).collect()}
        assert got[0] == (0.25, False) and got[1 + order.index(min(scores))] == (min(scores), True)
    far = spark.createDataFrame([(0, 1, 1e30), (0, 2, 3e30), (3, 4, None), (3, 1, 0.5)], "id_1 long, id_2 long, score double")
    got = {r["id"]: r["mean"] for r in cluster.outliers(far, clusters).collect()}
    assert got[0] == 2e30 and got[3] == 0.5 and got[4] is None


def test_sweeps_move_single_ids_to_the_older_cluster():
    # 4 is touched first by 3, so 5 joins it though it is the first of its pair
    assert cluster.sweep([(3, 4, 0.9), (5, 4, 0.9), (1, 2, 0.5)], 0.8) == {3: 0, 4: 0, 5: 0, 1: 1, 2: 1}
    assert cluster.sweep([(1, 2, 0.95), (3, 4, 0.9), (2, 4, 0.85)], 0.8) == {1: 0, 2: 0, 3: 0, 4: 0}
    assert cluster.sweep([(1, 2, 0.95), (3, 4, 0.5), (2, 4, 0.85)], 0.8) == {1: 0, 2: 0, 3: 1, 4: 0}


def test_clustering_end_to_end_matches_one_task(spark):
    rnd = random.Random(18)
    pairs = [(a, b, round(rnd.random(), 6)) for a in range(70) for b in range(a + 1, 70) if rnd.random() < 0.05]
    truth = [(i, i // 3) for i in range(75)]
    df, known = spark.createDataFrame(pairs, "id_1 long, id_2 long, score double"), spark.createDataFrame(truth, "id long, truth long")
    ordered = sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))

    def least(clusters):
        return {x: min(y for y in clusters if clusters[y] == clusters[x]) for x in clusters}

    def iou(clusters):
        total = 0
        for i, t in truth:
            mine = {x for x in clusters if i in clusters and clusters[x] == clusters[i]} or {i}
            own = {j for j, u in truth if u == t}
            total += len(mine & own) / len(mine | own)
        return total / len(truth)

    for mean_above, below in ((0.0, None), (0.6, None), (0.6, 0.4)):
        whole = cluster.grow([p for p in ordered if p[2] > 0.45], 0.6, 0.7)
        whole = cluster.merge_by_scores(ordered, whole, 0.9, mean_above, 12) if mean_above else cluster.merge([p for p in ordered if p[2] > 0.45], whole, 0.9, 12)
        if below:
            whole = cluster.without_outliers(ordered, whole, below)
        found = cluster.improved_clusters(df, 0.45, 0.6, 0.7, 0.9, mean_above, 12, below)
        assert {r["id"]: r["cluster"] for r in found.collect()} == least(whole)
        assert abs(evaluate.mean_iou(found, known).first()["iou"] - iou(whole)) < 1e-12
    labelled = df.withColumn("y", (F.floor(F.col("id_1") / 3) == F.floor(F.col("id_2") / 3)).cast("int"))
    got = {r["threshold"]: r["iou"] for r in evaluate.iou_by_threshold(labelled, known, (0.45, 0.6)).collect()}
    want = {t: iou(cluster.sweep([p for p in ordered if p[2] > t], 0.8)) for t in (0.45, 0.6)}
    want[0.0] = iou(cluster.sweep([(a, b, 1.0) for a, b, _ in sorted(pairs) if a // 3 == b // 3], 0.8))
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)


def test_cluster_functions_split_by_component(spark):
    rnd = random.Random(8)
    pairs = [(a, b, rnd.random()) for a in range(40) for b in range(a + 1, 40) if rnd.random() < 0.08]
    df = spark.createDataFrame(pairs, "id_1 long, id_2 long, score double")
    ordered = sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))
    whole = cluster.grow([p for p in ordered if p[2] > 0.3], 0.3, 0.6)
    got = {r["id"]: r["cluster"] for r in cluster.greedy_clusters(df, 0.3, 0.6, None).collect()}
    least = {h: min(x for x in whole if whole[x] == h) for h in set(whole.values())}
    assert got == {x: least[h] for x, h in whole.items()}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.4, 0)], "score double, y int")
    rows = [(r["score"], r["y"]) for r in df.collect()]
    wins = [(1.0 if p > q else 0.5 if p == q else 0.0) for p, a in rows if a for q, b in rows if not b]
    assert abs(evaluate.roc_auc(df).first()[0] - sum(wins) / len(wins)) < 1e-12


def test_tfidf_neighbours(spark):
    df = spark.createDataFrame([(1, "red plate house"), (2, "red plate home"), (3, "other words")], "id long, t string")
    pairs = tfidf.neighbours(tfidf.weights(df, "id", tfidf.words(F.col("t"))), "id", 0.1).collect()
    assert [(r["id_1"], r["id_2"]) for r in pairs] == [(1, 2)] and 0.3 < pairs[0]["sim"] < 0.9


def test_tfidf_neighbours_of_whole_texts(spark):
    rnd = random.Random(3)
    texts = ["common " * 3 + " ".join(f"w{int(rnd.random() ** 3 * 60)}" for _ in range(rnd.randint(1, 90))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0], "", None])), "id long, t string")
    weighted = tfidf.weights(df, "id", tfidf.words(F.col("t")))
    for threshold in (0.3, 0.45, 0.9):
        got, want = ({(r["id_1"], r["id_2"]): round(r["sim"], 9) for r in f(weighted, "id", threshold).collect()} for f in (tfidf.whole_neighbours, tfidf.neighbours))
        assert got == want and (0, 120) in got


def test_files_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b",\nc', 300), (2, None, -5)], "id int, t string, v int")
    write_csv(df, f"{tmp_path}/c")
    back = read_csv(spark, f"{tmp_path}/c", "id int, t string, v int")
    assert sorted(map(tuple, back.collect())) == [(1, 'a "b",\nc', 300), (2, "", -5)]
    assert sorted(r["v"] for r in clipped(df, {"v": ByteType()}).collect()) == [-5, 127]
    assert narrow_types(df)["id"] == ByteType() and narrow_types(df.withColumn("v", F.lit(100000)))["v"] == IntegerType()
    assert [r["id"] for r in first_rows(df, "id", 1).collect()] == [1]
    (tmp_path / "j.json").write_text('{"a": [1, 2]}\n')
    assert read_json(spark, str(tmp_path / "j.json"), "a array<long>").first()["a"] == [1, 2]


def test_small_table_operators(spark, tmp_path):
    from samewise.sources import tables

    df = spark.createDataFrame([(i, 0.125 + i / 4, "['a', \"b c\", 'd']") for i in range(40)], "id long, v double, l string")
    assert [r["v"] for r in tables.rounded(df, {"v": 2}).orderBy("id").limit(2).collect()] == [0.12, 0.38]
    assert df.select(tables.literal_list(F.col("l")).alias("x"), tables.literal_list(F.lit("oops")).alias("y")).first() == (["a", "b c", "d"], [])
    assert tables.with_last(df, ["id"]).columns == ["v", "l", "id"]
    a, b = ({r["id"] for r in tables.half(df, "id", s).collect()} for s in (0, 0))
    assert a == b and 8 < len(a) < 32 and a != {r["id"] for r in tables.half(df, "id", 1).collect()}
    back = tables.in_order(tables.numbered(df).repartition(5, "v"))
    assert [r["id"] for r in back.collect()] == list(range(40)) and back.columns == df.columns
    tables.write_matrix(df.withColumn("m", F.array("v", "v")), "id", "m", f"{tmp_path}/m")
    assert tables.read_matrix(spark, f"{tmp_path}/m").orderBy("id").first()["m"] == [0.125, 0.125]
    (tmp_path / "d.json").write_text('{"bar": ["pub", "inn"],\n "café": "cafe"}')
    assert tables.read_dictionary(spark, str(tmp_path / "d.json")) == {"bar": ["pub", "inn"], "café": "cafe"}


def test_midpoints_at_strips(spark):
    """Places are counted up to a tenth of a degree beyond the midpoint's whole degree, on either side and below zero."""
    from samewise.operators import targeted

    rnd = random.Random(4)
    at = [(i, rnd.uniform(-0.06, 0.06), rnd.choice([-1.02, -0.98, -0.1, -0.01, 0.0, 0.01, 0.09, 0.11, 0.99, 1.0, 1.05, 1.2]) + rnd.uniform(-0.005, 0.005), i % 3) for i in range(120)]
    df = spark.createDataFrame(at, "id long, latitude double, longitude double, kind int")
    pairs = [(i, i + 1) for i in range(0, 118)]
    for kind in (None, "kind"):
        got = {(r[0], r[1]): tuple(r)[2:] for r in targeted.midpoint_counts(spark.createDataFrame(pairs, "id_1 long, id_2 long"), df, kind).collect()}
        for a, b in pairs:
            y, x = (at[a][1] + at[b][1]) / 2, (at[a][2] + at[b][2]) / 2
            strip = math.floor(x)
            d = [(p[1] - y) ** 2 + math.cos(y) ** 2 * (p[2] - x) ** 2 for p in at if strip - 0.1 < p[2] < strip + 1.1 and (kind is None or p[3] in (at[a][3], at[b][3]))]
            assert got[a, b] == tuple(sum(v < r * r / 111111**2 for v in d) for r in targeted.RADII)


def test_cleaning_stream(spark, tmp_path):
    from samewise.streaming.cleaning import clean_stream, cleaned

    df = spark.createDataFrame([(1, "The Café"), (2, "of Rome")], "id int, text string")
    df.write.parquet(f"{tmp_path}/in")
    clean_stream(spark, f"{tmp_path}/in", "id int, text string", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, cleaned(df).collect())) and got[0][2] == "cafe"


def test_shifted_pairs_match_brute_force(spark):
    from samewise.functions.similarity import longest_subsequence, longest_substring

    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randint(0, 9))), rnd.randint(1, 2), "xy"[i % 2], round(rnd.uniform(0, 0.4), 4), round(rnd.uniform(0, 0.4), 4), 5.0 * (i % 3), 40.0) for i in range(130)]
    df = spark.createDataFrame(rows, "id long, name string, category int, country string, latitude double, longitude double, q90 double, q99 double")

    def metres(a, b):
        y1, x1, y2, x2 = (v * 3.14 / 180 for v in (a[4], a[5], b[4], b[5]))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 6373000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    def names(x, y, sub, seq, last):
        mean = (len(x) + len(y)) / 2
        begins = len(x) >= 4 and len(y) >= 4 and (y[:4] in x or x[:4] in y)
        return begins or (mean > 0 and (longest_substring(x, y) >= sub * mean or longest_subsequence(x, y) >= seq * mean)) or (len(x) >= last and len(y) >= last and x.endswith(y[-last:]))

    near = lambda r: (0, 0, r[1], r[4], r[2], r[3], r[0])
    want = set()
    for source, key, shifts in (("W11", near, 15), ("W12", lambda r: (r[3], round(r[4], 2), round(r[5], 2), r[2], r[0]), 107), ("W13", lambda r: (r[2], near(r)), 50)):
        order = sorted(rows, key=key)
        for s in range(1, shifts):
            for i, a in enumerate(order):
                b = order[(i + s) % len(rows)]
                m = metres(a, b)
                if source == "W13":
                    good = a[2] == b[2] and m < 400 * (a[6] + a[7]) and names(a[1], b[1], 0.6, 0.7, 6)
                else:
                    most = (500000 if s < 4 else 10000 if s < 8 else 5000 if s < 12 else 2000) if source == "W11" else max(100, 200 - (s - 2))
                    good = m < most or names(a[1], b[1], 0.65, 0.75, 7) or (a[2] == b[2] and m < a[6] * 900) or (source == "W11" and s == 1)
                if good:
                    want.add((a[0], b[0], s, "W10" if source == "W11" and s == 1 else source))
    got = [tuple(r) for r in blocking.shifted_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {w[3] for w in want} == {"W10", "W11", "W12", "W13"}


def test_ranks_are_places_on_many_files(spark, tmp_path):
    """300,000 rows in several files: samples of a range shuffle don't cover them, so its bounds differ from run to run."""
    n = 300_000
    spark.range(0, n, 1, 12).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"), "id").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    for parts in (None, 9):
        got = blocking.ranked(rows, ["v", "id"], parts=parts).orderBy("v", "id").toPandas()["rank"]
        assert (got == range(n)).all()
    rows = rows.withColumn("g", F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 6))
    near = blocking.sorted_neighbours(rows, "id", ["g"], ["v", "id"], 2, ["v"]).select("id_1", "id_2", "step", "v_2").toPandas()
    pdf = rows.toPandas()
    want = set()
    for _, g in pdf.sort_values(["v", "id"]).groupby("g", dropna=False):
        ids, v = g["id"].tolist(), g["v"].tolist()
        want |= {(ids[i], ids[i + s], s, v[i + s]) for s in (1, 2) for i in range(len(ids) - s)}
    assert len(near) == len(want) and set(near.itertuples(index=False, name=None)) == want


def test_auc_of_many_scores(spark, tmp_path):
    n = 300_000
    spark.range(0, n, 1, 12).select((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).alias("score"), (F.col("id") % 2).alias("y")).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    pdf = df.toPandas()
    ranks = pdf["score"].rank()
    p = int(pdf["y"].sum())
    want = (ranks[pdf["y"] == 1].sum() - p * (p + 1) / 2) / (p * (n - p))
    assert all(abs(evaluate.roc_auc(df).first()[0] - want) < 1e-12 for _ in range(2))


def test_models_saved_searched_and_stopped_early(spark, tmp_path):
    from samewise.operators import ml

    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7), int(i % 10 > 4), i // 10 % 3) for i in range(240)], "id long, a double, b double, y int, fold int")
    scored, models = ml.out_of_fold(rows, ["a", "b"], "y", "fold", 3, trees=3, depth=2)
    ml.save_models(models, f"file://{tmp_path}/models")
    again = ml.load_models(f"file://{tmp_path}/models", len(models))
    first, second = ({r["id"]: r["score"] for r in ml.ensemble(rows, ["a", "b"], m).collect()} for m in (models, again))
    assert first == second and len(first) == 240
    found = ml.search(rows, ["a", "b"], "y", "fold", 3, [{"trees": 1, "depth": 1}, {"trees": 2, "depth": 2}])
    assert [a for _, a in found] == sorted((a for _, a in found), reverse=True) and found[0][1] > 0.99
    stopped, short = ml.out_of_fold(rows, ["a", "b"], "y", "fold", 3, trees=12, depth=2, stop_early=True)
    assert stopped.count() == 240 and all(m.getNumTrees <= 12 for m in short)


def test_alike_texts_by_blocks_match_the_join_of_terms(spark, monkeypatch):
    rnd = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    rows = [(i * 7 % 200, " ".join(rnd.choice(words[: rnd.choice([4, 20, 60])]) for _ in range(rnd.randint(0, 9)))) for i in range(200)] + [(500, None), (501, ""), (502, " ".join(words))]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    terms = tfidf.words(F.col("t"))
    want = {(r["id_1"], r["id_2"]): round(r["sim"], 9) for r in tfidf.neighbours(tfidf.weights(df, "id", terms), "id", 0.45).collect()}
    assert len(want) > 100
    names = {w: (-1) ** i * (i + 1) * 10**15 for i, w in enumerate(words)}
    lists = [None if t is None else [names[w] for w in t.split()] for _, t in rows]
    task = type("Task", (), {"get": staticmethod(lambda: type("Now", (), {"partitionId": lambda self: 3})())})
    for block, entries, common, slab, some in ((2048, 1 << 22, 0.06, 512, 1 << 20), (7, 1 << 22, 0.06, 2, 30), (50, 40, 2.0, 512, 1), (16, 1 << 22, 0.0, 3, 9)):
        with monkeypatch.context() as set_to:
            for name, value in (("BLOCK", block), ("ENTRIES", entries), ("COMMON", common), ("SLAB", slab), ("PRODUCTS", some), ("GIVEN", some), ("TaskContext", task)):
                set_to.setattr(tfidf, name, value)
            parts = [pa.RecordBatch.from_pydict({"id": [r[0] for r in rows[i:j]], "t": [r[1] for r in rows[i:j]], "terms": pa.array(lists[i:j], pa.list_(pa.int64()))}) for i, j in ((0, 30), (30, 130), (130, len(rows)))]
            made = list(tfidf._blocks(iter(parts)))
            told = [dict(zip(b["hash"].to_pylist(), b["n"].to_pylist())) for m in made for b in tfidf._vocabularies(iter([m]))]
            total = {h: sum(t.get(h, 0) for t in told) for h in names.values()}
            made = [m.append_column("df", pa.array([b"".join(total[int.from_bytes(v[k : k + 8], "little", signed=True)].to_bytes(8, "little") for k in range(0, len(v), 8)) for v in m["vocab"].to_pylist()])) for m in made]
            pairs = [pa.RecordBatch.from_arrays([*x.columns, *y.columns], names=[f"{c}_{i}" for i in (1, 2) for c in x.schema.names]) for n, x in enumerate(made) for y in made[n:] if len(x["vocab"][0].as_py()) and len(y["vocab"][0].as_py())]
            got = [r for b in tfidf._alike(len(rows), 0.45, ["t"])(iter(pairs)) for r in b.to_pylist()]
            assert len(got) == len(want) and {(r["id_1"], r["id_2"]): round(r["sim"], 9) for r in got} == want
    found = tfidf.alike(df, "id", terms, 0.45, ["t"])
    text = dict(rows)
    got = {(r["id_1"], r["id_2"]): r for r in found.collect()}
    assert {k: round(r["sim"], 9) for k, r in got.items()} == want
    assert all((r["t_1"], r["t_2"]) == (text[a], text[b]) for (a, b), r in got.items())
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()  # no pair is shuffled
    assert tfidf.alike(df.where("false"), "id", terms, 0.45).count() == 0


def test_alike_names_of_airports_and_countries_shuffle_no_pairs(spark):
    from samewise.operators import targeted

    rows = [(i, f"{('north', 'south', 'old')[i % 3]} field {i % 5}x", i % 4, (2, 3, 32)[i % 3], 1.0 + i / 100, 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, category int, country int, latitude double, longitude double")
    for found in (targeted.airports(df), targeted.in_country(df)):
        assert found.count() == found.distinct().count() > 0
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_names_measures_only_pairs_that_can_be_alike(spark):
    from samewise.functions import similarity
    from samewise.operators import targeted

    rnd = random.Random(41)
    rows = [(i, "".join(rnd.choice("abcd "[: rnd.choice([2, 5])]) for _ in range(rnd.choice([0, 1, 3, 9, 40]))) if i % 20 else (None, "xyzw")[i % 40 > 0], 2 + i % 2, 1 + i % 7 / 100, 2.0) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, name string, country int, latitude double, longitude double")
    want, longest = set(), similarity.longest_substring
    for i, x, c, *_ in rows:
        for j, y, d, *_ in rows[i + 1 :]:
            if c == d and x and y and (len(x) >= 4 and len(y) >= 4 and (x[:4] in y or y[:4] in x) or 4 * longest(x, y) >= len(x) + len(y)):
                want.add((i, j))
    found = targeted.near_with_like_name(df)
    assert {tuple(r) for r in found.collect()} == want and 100 < len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "exists" in plan[plan.index("ArrowEvalPython") :]  # a filter below the kernel


def test_near_names_are_whole_and_shuffle_no_pairs(spark, monkeypatch):
    from samewise.functions.similarity import longest_substring
    from samewise.operators import near, targeted

    rnd = random.Random(43)
    name = lambda kinds: "".join(rnd.choice("abcde é"[: kinds]) for _ in range(rnd.choice([0, 1, 2, 3, 6, 9, 40, 80])))
    rows = [(i, name(rnd.choice([2, 2, 4, 7])) if i % 23 else (None, "xyzw", "xyz", "é")[i % 4], (2, 2, 2, 3, 4, None)[rnd.randint(0, 5)], round(rnd.uniform(-0.2, 0.2), 2), rnd.choice([-0.12, 0.0, 0.12, 0.24, 0.36]) if i % 31 else None) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, name string, country int, latitude double, longitude double").repartition(3)
    want = set()
    for i, x, c, lat, lon in rows:
        for j, y, d, lat_2, lon_2 in rows[i + 1 :]:
            if c == d and c in (2, 3) and x and y and None not in (lon, lon_2) and math.sqrt((lat - lat_2) ** 2 + (lon - lon_2) ** 2) <= 0.12:
                if len(x) >= 4 and len(y) >= 4 and (x[:4] in y or y[:4] in x) or 4 * longest_substring(x, y) >= len(x) + len(y):
                    want.add((i, j))
    for block, meetings in ((1024, 16), (5, 3)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "MEETINGS", meetings)
        found = targeted.near_with_like_name(df, k=None)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "ArrowEvalPython" not in plan and "hashpartitioning(id" not in plan
    assert targeted.near_with_like_name(df.where("false"), k=None).count() == 0


def test_alike_texts_in_an_order_make_alike_blocks(spark, monkeypatch):
    rnd = random.Random(47)
    rows = [(i, " ".join(f"{'abc'[i % 3]}w{int(rnd.random() ** 2 * 30)}" for _ in range(rnd.randint(0, 12))), "xyz"[i % 3]) for i in range(200)] + [(300, None, None), (301, "common", "x")]
    df = spark.createDataFrame(rows, "id long, t string, lang string")
    terms = tfidf.words(F.col("t"))
    want = {(r["id_1"], r["id_2"]): round(r["sim"], 9) for r in tfidf.neighbours(tfidf.weights(df, "id", terms), "id", 0.45).collect()}
    monkeypatch.setattr(tfidf, "BLOCK", 5)  # so that the driver deals texts over ten partitions, each a block at least
    held, write = [], tfidf.written
    monkeypatch.setattr(tfidf, "written", lambda made, name: held.append(write(made, name)) or held[-1])
    monkeypatch.setattr(tfidf, "drop_written", lambda made: None)
    found = tfidf.alike(df, "id", terms, 0.45, order=[F.col("lang"), F.length("t")])
    got = [(r["id_1"], r["id_2"], round(r["sim"], 9)) for r in found.collect()]
    assert len(got) == len(want) > 100 and {(a, b): s for a, b, s in got} == want
    lang = {i: l for i, _, l in rows}
    blocks = [pa.ipc.open_stream(b["rows"]).read_all()["id"].to_pylist() for b in held[0].collect()]
    assert sum(len({lang[i] for i in ids}) == 1 for ids in blocks) > 5  # most blocks are of one language
