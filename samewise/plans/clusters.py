"""Queries of graphs, clusters and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import text
from samewise.operators import blocking, cluster, evaluate
from samewise.operators.graph import components
from samewise.plans.measures import part_pairs
from samewise.plans.registry import query, sql_without
from samewise.sources.tables import parts, table

# Scored pairs of parts: neighbours of a brand by name, by a score from their keys; the truth is the name.
_SCORED = "p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn FROM part), scored AS (SELECT a.p_partkey AS id_1, b.p_partkey AS id_2, (a.p_partkey * 31 + b.p_partkey * 17) % 101 / 100 AS score, CASE WHEN a.p_name = b.p_name THEN 1 ELSE 0 END AS y FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.rn BETWEEN a.rn + 1 AND a.rn + 2)"
# Clusters by a rule, for the queries that take clusters as given.
_CLUSTERS = "clusters AS (SELECT p_partkey AS id, p_partkey - p_partkey % 4 AS cluster FROM part)"


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("id_1") * 31 + F.col("id_2") * 17) % 101 / 100
    return part_pairs(spark, d).select("id_1", "id_2", score.alias("score"), (F.col("name_1") == F.col("name_2")).cast("int").alias("y"))


def given_clusters(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", (F.col("id") - F.col("id") % 4).alias("cluster"))


_COMPONENTS = "least AS (SELECT x, min(y) AS component FROM reach GROUP BY x)"


@query(
    f"""WITH RECURSIVE {_SCORED}, e AS (SELECT id_1 AS x, id_2 AS y FROM scored WHERE score > 0.7 UNION SELECT id_2, id_1 FROM scored WHERE score > 0.7), reach AS (SELECT x, x AS y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x), {_COMPONENTS}
    SELECT x AS id, component, count(*) OVER (PARTITION BY component) AS size FROM least"""
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    found = components(scored_pairs(spark, d).where("score > 0.7"), "id_1", "id_2")
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size")


@query(
    f"""WITH RECURSIVE n AS (SELECT p_partkey AS id, p_brand, left({sql_without("lower(p_name)", text.SYMBOLS)}, 76) AS name FROM part), p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY name, id) AS rn FROM n),
    e0 AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) > 0.85),
    e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0), reach AS (SELECT x, x AS y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x), {_COMPONENTS}
    SELECT component, count(*) AS n FROM least GROUP BY component"""
)
def linked_parts(spark: SparkSession, d: str) -> DataFrame:
    """Which parts are the same thing: cleaned names, neighbours by name within a brand, edit distance, components."""
    rows = parts(spark, d).select("id", "brand", F.left(text.normal(F.col("name")), F.lit(76)).alias("name"))
    pairs = blocking.sorted_neighbours(rows, "id", ["brand"], ["name", "id"], 3, ["name"])
    share = 1 - F.levenshtein("name_1", "name_2") / F.greatest(F.length("name_1"), F.length("name_2"))
    found = components(pairs.where(share > 0.85), "id_1", "id_2")
    return found.groupBy("component").agg(F.count("*").alias("n"))


@query()
def greedy_cluster(spark: SparkSession, d: str) -> DataFrame:
    return cluster.greedy_clusters(scored_pairs(spark, d), small=0.7, big=0.85, merge_above=0.9, most=20)


@query()
def first_touch_cluster_sweep(spark: SparkSession, d: str) -> DataFrame:
    return cluster.members(cluster.sweep_clusters(scored_pairs(spark, d), threshold=0.75, tie=0.9))


@query(
    f"""WITH {_SCORED}, {_CLUSTERS}, x AS (SELECT least(a.cluster, b.cluster) AS cluster_1, greatest(a.cluster, b.cluster) AS cluster_2, score FROM scored JOIN clusters a ON a.id = id_1 JOIN clusters b ON b.id = id_2 WHERE a.cluster <> b.cluster)
    SELECT cluster_1, cluster_2, round(max(score), 6) AS most, round(avg(score), 6) AS mean, count(*) AS n FROM x GROUP BY cluster_1, cluster_2 HAVING max(score) > 0.9 OR (avg(score) > 0.6 AND count(*) > 1)"""
)
def cluster_merge_stats(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.mergeable(cluster.between_clusters(scored_pairs(spark, d), given_clusters(spark, d)))
    return found.select("cluster_1", "cluster_2", F.round("most", 6).alias("most"), F.round("mean", 6).alias("mean"), "n")


_BRANDS = "brands AS (SELECT p_partkey AS id, p_brand || '-' || p_name AS cluster FROM part)"


@query(
    f"""WITH {_SCORED}, {_BRANDS}, i AS (SELECT id_1, id_2, a.cluster, score FROM scored JOIN brands a ON a.id = id_1 JOIN brands b ON b.id = id_2 WHERE a.cluster = b.cluster),
    m AS (SELECT id, cluster, avg(score) AS mean FROM (SELECT id_1 AS id, cluster, score FROM i UNION ALL SELECT id_2, cluster, score FROM i) GROUP BY id, cluster), s AS (SELECT cluster, count(*) AS n FROM brands GROUP BY cluster)
    SELECT id, cluster, round(mean, 6) AS mean, n > 2 AND mean < 0.25 AS outlier FROM m JOIN s USING (cluster)"""
)
def cluster_outliers(spark: SparkSession, d: str) -> DataFrame:
    brands = parts(spark, d).select("id", F.concat_ws("-", "brand", "name").alias("cluster"))
    return cluster.outliers(scored_pairs(spark, d), brands).withColumn("mean", F.round("mean", 6))


@query(
    """WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'own-' || p_partkey ELSE 'c-' || (p_partkey - p_partkey % 4) END AS cluster, p_brand || p_name AS truth FROM part),
    s AS (SELECT cluster, truth, count(*) AS c FROM b GROUP BY cluster, truth), p AS (SELECT cluster, count(*) AS np FROM b GROUP BY cluster), t AS (SELECT truth, count(*) AS nt FROM b GROUP BY truth)
    SELECT id, round(c / (np + nt - c), 6) AS iou FROM b JOIN s USING (cluster, truth) JOIN p USING (cluster) JOIN t USING (truth)"""
)
def iou_evaluation(spark: SparkSession, d: str) -> DataFrame:
    truth = parts(spark, d).select("id", F.concat("brand", "name").alias("truth"))
    return evaluate.cluster_iou(given_clusters(spark, d).where("id % 7 <> 0"), truth).withColumn("iou", F.round("iou", 6))


@query(f"WITH {_SCORED} SELECT t.threshold, count(CASE WHEN score > t.threshold THEN 1 END) AS kept, count(CASE WHEN score > t.threshold AND y = 1 THEN 1 END) AS matches, count(CASE WHEN y = 1 THEN 1 END) AS all_matches FROM scored, (VALUES (0.005::DOUBLE), (0.4::DOUBLE), (0.45::DOUBLE), (0.6::DOUBLE)) t(threshold) GROUP BY t.threshold")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_table(scored_pairs(spark, d), [0.005, 0.4, 0.45, 0.6])


@query(
    f"""WITH {_SCORED}, t AS (SELECT p_brand || p_name AS truth, count(*) AS n FROM part GROUP BY 1), f AS (SELECT count(*) AS candidates, CAST(sum(y) AS BIGINT) AS matches, avg(y) AS match_share, count(DISTINCT CASE WHEN y = 1 THEN id_1 END) AS left_ids FROM scored)
    SELECT candidates, matches, round(match_share, 6) AS match_share, left_ids, (SELECT sum(n * (n - 1) / 2) FROM t) AS true_pairs, round(matches / (SELECT sum(n * (n - 1) / 2) FROM t), 6) AS recall FROM f"""
)
def candidate_report(spark: SparkSession, d: str) -> DataFrame:
    truth = parts(spark, d).select("id", F.concat("brand", "name").alias("truth"))
    found = evaluate.candidate_report(scored_pairs(spark, d).select("id_1", "id_2"), truth)
    return found.withColumn("match_share", F.round("match_share", 6)).withColumn("recall", F.round("recall", 6))


@query(
    """WITH s AS (SELECT d.doc_id, n_chars % 997 AS score, toxic AS y FROM documents d JOIN labels l USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s)
    SELECT round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r"""
)
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 997).alias("score")).join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    return evaluate.roc_auc(rows).withColumn("auc", F.round("auc", 6))


@query("SELECT quality AS label, CAST(n_chars > 1000 AS INT) AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return evaluate.confusion(rows, F.col("n_chars") > 1000, F.col("quality"))


@query(f"WITH {_SCORED}, r AS (SELECT id_1, id_2, score, row_number() OVER (PARTITION BY id_1 ORDER BY score DESC, id_1, id_2) AS nth FROM scored WHERE score > 0.3) SELECT id_1, id_2, round(score, 6) AS score, nth FROM r WHERE nth <= 1")
def ranked_scores_topn(spark: SparkSession, d: str) -> DataFrame:
    best = cluster.best_scores(scored_pairs(spark, d).where("score > 0.3"), "id_1", 1)
    return best.select("id_1", "id_2", F.round("score", 6).alias("score"), "nth")
