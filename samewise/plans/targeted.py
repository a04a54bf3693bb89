"""Queries of blockers for one kind of place, of counts around pairs, and of clustering end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import text
from samewise.operators import cluster, evaluate, targeted
from samewise.operators.blocking import sorted_neighbours
from samewise.plans.blocks import _LONGEST
from samewise.plans.clusters import scored_pairs
from samewise.plans.registry import query, sql_replaced
from samewise.sources.tables import half, in_order, named_documents, numbered, parts, rounded, table, with_last

# Documents as places: the name is the text's beginning, country follows the language, the rest the key.
_PLACES = "places AS (SELECT doc_id AS id, lower(left(text, 76)) AS name, doc_id % 6 - 1 AS category, CASE lang WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'en' THEN 32 ELSE 4 END AS country, (doc_id * 7919 % 200) / 100 AS latitude, (doc_id * 104729 % 200) / 100 AS longitude FROM documents)"
_KM = "2 * 6371.0 * asin(sqrt(pow(sin((b.latitude - a.latitude) * (pi() / 180) / 2), 2) + cos(a.latitude * (pi() / 180)) * cos(b.latitude * (pi() / 180)) * pow(sin((b.longitude - a.longitude) * (pi() / 180) / 2), 2)))"


def places(spark: SparkSession, d: str) -> DataFrame:
    country = F.when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).when(F.col("lang") == "en", 32).otherwise(4)
    rows = named_documents(spark, d).select("id", F.lower("name").alias("name"), (F.col("id") % 6 - 1).cast("int").alias("category"), country.alias("country"))
    return rows.withColumn("latitude", F.col("id") * 7919 % 200 / 100).withColumn("longitude", F.col("id") * 104729 % 200 / 100)


def _like(tag: str, names: str, threshold: float) -> str:
    """SQL tables ending in like_<tag> (id_1, id_2, sim) of names (id, name)."""
    return f"""t_{tag} AS (SELECT id, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_]+')) AS term FROM ({names})), c_{tag} AS (SELECT id, term, count(*) AS tf FROM t_{tag} GROUP BY id, term),
    w_{tag} AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM ({names}))) / (1 + df)) + 1) AS w FROM c_{tag} JOIN (SELECT term, count(*) AS df FROM c_{tag} GROUP BY term) USING (term)),
    n_{tag} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w_{tag}),
    like_{tag} AS (SELECT a.id AS id_1, b.id AS id_2, sum(a.w * b.w) AS sim FROM n_{tag} a JOIN n_{tag} b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= {threshold})"""


_TERMINAL = "trim(" + sql_replaced("name", [*((f"{w}{i}", "") for i in range(30) for w in ("terminal ", "terminal", "t")), *text.TERMINAL_SPELLINGS, *((w + s, "") for w in text.TERMINAL_WORDS for s in ("s", ""))]) + ")"
_STATION = "trim(" + sql_replaced("name", [(w + s, "") for w in text.STATION_WORDS for s in ("s", "")]) + ")"
_SIDES = "JOIN places a ON a.id = id_1 JOIN places b ON b.id = id_2"


@query(
    f"""WITH {_PLACES}, {_like("x", f"SELECT * FROM (SELECT id, {_TERMINAL} AS name FROM places WHERE category IN (1, 2, -1)) WHERE length(name) >= 2", 0.45)}
    SELECT id_1, id_2 FROM like_x {_SIDES} WHERE (a.category = 1 OR b.category = 1) AND ({_KM} <= 100 OR contains(a.name, 'kualalumpur'))"""
)
def airport_names(spark: SparkSession, d: str) -> DataFrame:
    return targeted.airports(places(spark, d))


@query(
    f"""WITH {_PLACES}, {_like("x", f"SELECT * FROM (SELECT id, {_STATION} AS name FROM places WHERE category = 4) WHERE length(name) >= 3", 0.45)},
    {_like("y", f"SELECT * FROM (SELECT id, {_STATION} AS name FROM (SELECT id, category, replace(name, 'e', 'i') AS name FROM places) WHERE category = 4) WHERE length(name) >= 3", 0.45)},
    p AS (SELECT id_1, id_2 FROM like_x UNION SELECT id_1, id_2 FROM like_y) SELECT id_1, id_2 FROM p {_SIDES} WHERE {_KM} <= 100"""
)
def station_names(spark: SparkSession, d: str) -> DataFrame:
    """With a second spelling of each name."""
    return targeted.stations(places(spark, d).withColumn("decoded", F.replace("name", F.lit("e"), F.lit("i"))), ["name", "decoded"])


_TIERS = " UNION ALL ".join(
    f"SELECT id_1, id_2 FROM like_{c} {_SIDES} WHERE {_KM} <= {far} AND ((a.category = b.category AND a.category > 0) OR ({_KM} <= {other} AND round(sim, 5) >= {least}))" for c, (least, far, other) in targeted.COUNTRY_TIERS.items()
)


@query(f"WITH {_PLACES}, {', '.join(_like(str(c), f'SELECT id, name FROM places WHERE country = {c}', min(0.45, least)) for c, (least, _, _) in targeted.COUNTRY_TIERS.items())} {_TIERS}")
def country_names(spark: SparkSession, d: str) -> DataFrame:
    return targeted.in_country(places(spark, d))


_BUCKETS = "keyed AS (SELECT id, name AS v, 'n' AS k, 25 AS most FROM places UNION ALL SELECT doc_id, source || '-' || n_chars, 's', 10 FROM documents), r AS (SELECT k, v FROM keyed WHERE v <> '' GROUP BY k, v, most HAVING count(*) > 1 AND count(*) <= most)"


@query(
    f"""WITH {_PLACES}, {_BUCKETS}, p AS (SELECT DISTINCT x.id AS id_1, y.id AS id_2 FROM keyed x JOIN r USING (k, v) JOIN keyed y USING (k, v) WHERE x.id < y.id), c AS (SELECT name, count(*) AS n FROM places GROUP BY name)
    SELECT id_1, id_2 FROM p {_SIDES} JOIN c ON c.name = a.name WHERE {_KM} <= CASE WHEN a.category = 1 OR b.category = 1 THEN 100000 WHEN a.category = 2 OR b.category = 2 THEN 350 WHEN a.name = b.name AND c.n <= 5 THEN 100 ELSE 26 END + CASE WHEN a.name = b.name AND length(a.name) >= 10 THEN 15 ELSE 0 END"""
)
def bucket_distance_rule(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("-", "source", "n_chars").alias("size"))
    return targeted.shared_buckets(places(spark, d).join(size, "id"), {"name": 25, "size": 10})


@query(
    f"""WITH {_PLACES}, p AS MATERIALIZED (SELECT a.id AS id_1, b.id AS id_2, a.name AS x, b.name AS y FROM places a JOIN places b ON a.country = b.country AND a.id < b.id AND a.country IN (2, 3) AND sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)) <= 0.12)
    SELECT id_1, id_2 FROM p WHERE (length(x) >= 4 AND length(y) >= 4 AND (contains(x, left(y, 4)) OR contains(y, left(x, 4)))) OR (length(x) + length(y) > 0 AND 2 * {_LONGEST.format(a='x', b='y')} / (length(x) + length(y)) >= 0.5)"""
)
def near_names(spark: SparkSession, d: str) -> DataFrame:
    """All neighbours within the distance, as the SQL has no limit of 400 (which places reach from 0.5 GB on)."""
    return targeted.near_with_like_name(places(spark, d), k=None)


_NEXT = "places_n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY id) AS rn FROM places), p AS (SELECT a.id AS id_1, b.id AS id_2, (a.latitude + b.latitude) / 2 AS y, (a.longitude + b.longitude) / 2 AS x, a.category AS k1, b.category AS k2 FROM places_n a JOIN places_n b ON a.country = b.country AND b.rn = a.rn + 1)"
_COUNTS = ", ".join(f"count(CASE WHEN d < {r * r / targeted.DEGREE**2!r} THEN 1 END) AS near_{r}" for r in targeted.RADII)


def _counts_sql(category: str) -> str:
    strip = "longitude > floor(x) - 0.1 AND longitude < floor(x) + 1 + 0.1"
    return f"WITH {_PLACES}, {_NEXT}, m AS (SELECT id_1, id_2, pow(latitude - y, 2) + pow(cos(y), 2) * pow(longitude - x, 2) AS d FROM p LEFT JOIN places ON {strip}{category}) SELECT id_1, id_2, {_COUNTS} FROM m GROUP BY id_1, id_2"


def next_places(spark: SparkSession, d: str) -> DataFrame:
    return sorted_neighbours(places(spark, d), "id", ["country"], ["id"], 1).select("id_1", "id_2")


@query(_counts_sql(""))
def midpoint_radius_counts(spark: SparkSession, d: str) -> DataFrame:
    return targeted.midpoint_counts(next_places(spark, d), places(spark, d))


@query(_counts_sql(" AND (category = k1 OR category = k2)"))
def midpoint_category_counts(spark: SparkSession, d: str) -> DataFrame:
    return targeted.midpoint_counts(next_places(spark, d), places(spark, d), "category")


@query(
    """WITH c AS (SELECT p_type AS category, avg(p_size) AS mean, max(p_size) AS most FROM part WHERE p_size > 10 GROUP BY p_type), r AS (SELECT p_partkey AS id, unnest([p_type, p_brand, 'none']) AS category FROM part),
    m AS (SELECT id, max(mean) AS mean, max(most) AS most FROM r LEFT JOIN c USING (category) GROUP BY id) SELECT id, round(coalesce(mean, 7.5), 6) AS mean, coalesce(CAST(most AS DOUBLE), 9.0) AS most FROM m"""
)
def category_vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    known = rows.where("size > 10").groupBy("category").agg(F.avg("size").alias("mean"), F.max("size").cast("double").alias("most"))
    found = targeted.widest_of_categories(rows.withColumn("labels", F.array("category", "brand", F.lit("none"))), "id", "labels", known, ["mean", "most"], [7.5, 9.0])
    return found.withColumn("mean", F.round("mean", 6))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", F.concat("brand", "name").alias("truth"))


@query()
def improved_iou(spark: SparkSession, d: str) -> DataFrame:
    """Clusters grown and merged, by single scores and by means, without and with outliers freed: mean IoU of each."""
    scored, truth, found = scored_pairs(spark, d), _truth(spark, d), []
    for mean_above in (0.0, 0.6):
        for below in (None, 0.25):
            clusters = cluster.improved_clusters(scored, mean_above=mean_above, outliers_below=below)
            found.append(evaluate.mean_iou(clusters, truth).select(F.lit(mean_above).alias("mean_above"), F.lit(below is not None).alias("freed"), F.round("iou", 6).alias("iou")))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query()
def iou_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.iou_by_threshold(scored_pairs(spark, d), _truth(spark, d)).withColumn("iou", F.round("iou", 6))


@query("SELECT doc_id AS id, round_even((doc_id * 7919 % 200) / 8, 1) AS latitude FROM documents")
def half_even_rounding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7919 % 200 / 8).alias("latitude")), {"latitude": 1})


@query("SELECT doc_id, source, n_chars, lang FROM documents")
def columns_at_the_end(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"))
    return with_last(in_order(rows), ["lang"])


@query()
def random_half(spark: SparkSession, d: str) -> DataFrame:
    return half(table(spark, d, "documents").select("doc_id"), "doc_id")
