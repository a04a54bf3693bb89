"""Queries of similarities, distances and pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import geo, similarity
from samewise.operators import features, tfidf
from samewise.operators.blocking import sorted_neighbours
from samewise.plans.registry import query
from samewise.sources.tables import customers, named_documents, parts, table

_PARTS = "p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn FROM part), q AS (SELECT a.p_partkey AS id_1, b.p_partkey AS id_2, a.p_name AS x, b.p_name AS y, a.p_type AS u, b.p_type AS v FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.rn BETWEEN a.rn + 1 AND a.rn + 2)"
_DOCS = "d AS (SELECT doc_id AS id, left(text, 76) AS name, source, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), q AS (SELECT a.id AS id_1, b.id AS id_2, a.name AS x, b.name AS y FROM d a JOIN d b ON a.lang = b.lang AND b.rn = a.rn + 1)"
_CUSTOMER = "(SELECT c_custkey AS id, c_nationkey AS country, c_mktsegment AS segment, (c_custkey * 7919 % 18000) / 100 - 90 AS latitude, (c_custkey * 104729 % 36000) / 100 - 180 AS longitude FROM customer)"
_LONGEST = "coalesce(list_max(list_transform(range(1, length(x) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(x) - i + 2), lambda n: contains(y, substring(x, i, n)))), 0))), 0)"
KEYWORDS = ["the", "and", "of", "de", "la", "que", "der", "und", "in", "en"]


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand with the next two by name: id_1, id_2, name_1, name_2, category_1, category_2."""
    return sorted_neighbours(parts(spark, d), "id", ["brand"], ["name", "id"], 2, ["name", "category"]).drop("step")


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sorted_neighbours(named_documents(spark, d), "id", ["lang"], ["id"], 1, ["name"]).drop("step")


_OVERLAP = "CASE WHEN least(length(x), length(y)) > 0 THEN len(list_filter(range(1, least(length(x), length(y)) + 1), lambda n: contains(x, {0}(y, n)) OR contains(y, {0}(x, n)))) ELSE 0 END"


@query(f"WITH {_PARTS} SELECT id_1, id_2, {_OVERLAP.format('left')} AS pi, {_OVERLAP.format('right')} AS pi2, CASE WHEN length(x) >= 4 AND length(y) >= 4 AND (contains(x, left(y, 4)) OR contains(y, left(x, 4))) THEN 1 ELSE 0 END AS pi1 FROM q")
def prefix_suffix_overlap(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("name_1"), F.col("name_2")
    return part_pairs(spark, d).select("id_1", "id_2", similarity.prefix_overlap(x, y).alias("pi"), similarity.suffix_overlap(x, y).alias("pi2"), similarity.begins_inside(x, y).alias("pi1"))


@query(f"WITH {_PARTS} SELECT id_1, id_2, n AS lcs2, round(2 * n / (length(x) + length(y)), 6) AS substring_ratio FROM (SELECT *, {_LONGEST} AS n FROM q)")
def longest_common_substring(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("name_1"), F.col("name_2")
    found = part_pairs(spark, d).withColumn("lcs2", similarity.kernel("int", similarity.longest_substring)(x, y))
    return found.select("id_1", "id_2", "lcs2", F.round(similarity.mean_length_ratio(F.col("lcs2"), x, y), 6).alias("substring_ratio"))


_DP = """WITH RECURSIVE {0}, k AS (SELECT DISTINCT x, y FROM q), r AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda z: 0) AS row FROM k UNION ALL
  SELECT x, y, i + 1, list_reduce(list_concat([[0]], list_transform(range(1, length(y) + 1), lambda j: [CASE WHEN substring(y, j, 1) = substring(x, i + 1, 1) THEN row[j] + 1 ELSE row[j + 1] END])), lambda s, v: list_append(s, greatest(s[-1], v[1]))) FROM r WHERE i < length(x))"""


@query(f"{_DP.format(_PARTS)} SELECT q.id_1, q.id_2, CAST(row[-1] AS INT) AS lcs, round(2 * row[-1] / (length(q.x) + length(q.y)), 6) AS subseq_ratio FROM q JOIN r ON r.x = q.x AND r.y = q.y AND r.i = length(r.x)")
def longest_common_subsequence(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("name_1"), F.col("name_2")
    found = part_pairs(spark, d).withColumn("lcs", similarity.kernel("int", similarity.longest_subsequence)(x, y))
    return found.select("id_1", "id_2", "lcs", F.round(similarity.mean_length_ratio(F.col("lcs"), x, y), 6).alias("subseq_ratio"))


@query()
def block_lcs(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("name_1"), F.col("name_2")
    return part_pairs(spark, d).select("id_1", "id_2", similarity.kernel("int", lambda a, b: similarity.common_blocks(a, b, 3)[0])(x, y).alias("cc_lcs"), similarity.kernel("int", lambda a, b: similarity.common_blocks(a, b, 3)[1])(x, y).alias("ll_lcs"))


@query(
    f"""WITH {_PARTS} SELECT id_1, id_2, levenshtein(x, y) AS ld, round(levenshtein(lower(x), lower(y)) / greatest(length(x), length(y)), 6) AS name_levenshtein, round(abs(length(x) - length(y)) / greatest(length(x), length(y)), 6) AS name_len_diff, round(levenshtein(lower(u), lower(v)) / greatest(length(u), length(v)), 6) AS category_levenshtein FROM q"""
)
def edit_distance_features(spark: SparkSession, d: str) -> DataFrame:
    x, y, u, v = (F.col(c) for c in ("name_1", "name_2", "category_1", "category_2"))
    return part_pairs(spark, d).select("id_1", "id_2", F.levenshtein(x, y).alias("ld"), F.round(similarity.edit_share(x, y), 6).alias("name_levenshtein"), F.round(similarity.length_share(x, y), 6).alias("name_len_diff"), F.round(similarity.edit_share(u, v), 6).alias("category_levenshtein"))


@query(f"WITH {_PARTS} SELECT id_1, id_2, round(jaro_winkler_similarity(x, y), 6) AS name_ljw, round(jaro_winkler_similarity(u, v), 6) AS category_ljw FROM q")
def jaro_winkler_features(spark: SparkSession, d: str) -> DataFrame:
    jw = similarity.kernel("double", similarity.jaro_winkler)
    return part_pairs(spark, d).select("id_1", "id_2", F.round(jw(F.col("name_1"), F.col("name_2")), 6).alias("name_ljw"), F.round(jw(F.col("category_1"), F.col("category_2")), 6).alias("category_ljw"))


@query()
def sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    return part_pairs(spark, d).select("id_1", "id_2", F.round(similarity.kernel("double", similarity.sequence_ratio)(F.col("name_1"), F.col("name_2")), 6).alias("dsm1"))


@query()
def fuzzy_token_ratios(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("name_1"), F.col("name_2")
    return part_pairs(spark, d).select("id_1", "id_2", F.round(similarity.kernel("double", similarity.weighted_ratio)(x, y), 6).alias("wratio"), F.round(similarity.kernel("double", similarity.partial_ratio)(x, y), 6).alias("partial_ratio"))


_HITS = "[" + ", ".join(f"CAST(contains({{0}}, '{w}') AS INT)" for w in KEYWORDS) + "]"


@query(f"WITH {_DOCS} SELECT id_1, id_2, CAST(c AS INT) AS word_c_n, round(CASE WHEN n > 0 THEN c / sqrt(n) ELSE 0 END, 6) AS word_c_cs FROM (SELECT id_1, id_2, list_inner_product(a::DOUBLE[], b::DOUBLE[]) AS c, list_sum(a) * list_sum(b) AS n FROM (SELECT id_1, id_2, {_HITS.format('x')} AS a, {_HITS.format('y')} AS b FROM q))")
def keyword_vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    cosine, n = similarity.hit_cosine(similarity.keyword_hits(F.col("name_1"), KEYWORDS), similarity.keyword_hits(F.col("name_2"), KEYWORDS))
    return document_pairs(spark, d).select("id_1", "id_2", n.alias("word_c_n"), F.round(cosine, 6).alias("word_c_cs"))


_GRAMS = "flatten(list_transform(list_filter(string_split(lower({0}), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 1), lambda i: substring(' ' || w || ' ', i, 3))))"


@query(
    f"""WITH {_PARTS}, g AS (SELECT id_1, id_2, {_GRAMS.format('x')} AS a, {_GRAMS.format('y')} AS b FROM q)
    SELECT id_1, id_2, round(list_sum(list_transform(a, lambda z: len(list_filter(b, lambda t: t = z)))) / (sqrt(list_sum(list_transform(a, lambda z: len(list_filter(a, lambda t: t = z))))) * sqrt(list_sum(list_transform(b, lambda z: len(list_filter(b, lambda t: t = z)))))), 6) AS sim FROM g"""
)
def char_trigram_cosine(spark: SparkSession, d: str) -> DataFrame:
    return part_pairs(spark, d).select("id_1", "id_2", F.round(tfidf.trigram_cosine(F.col("name_1"), F.col("name_2")), 6).alias("sim"))


_PLACES = f"c AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY id) AS rn FROM {_CUSTOMER}), q AS (SELECT a.id AS id_1, b.id AS id_2, a.latitude AS la, a.longitude AS lo, b.latitude AS lb, b.longitude AS lp FROM c a JOIN c b ON a.country = b.country AND b.rn = a.rn + 1)"
_H = "pow(sin((lb - la) * {0} / 2), 2) + cos(la * {0}) * cos(lb * {0}) * pow(sin((lp - lo) * {0} / 2), 2)"


@query(
    f"""WITH {_PLACES}, m AS (SELECT *, 2 * 6373000.0 * atan2(sqrt(h), sqrt(1 - h)) AS metres, 111173.444444444 * abs(la - lb) AS north FROM (SELECT *, {_H.format('(3.14 / 180)')} AS h, {_H.format('(pi() / 180)')} AS k FROM q))
    SELECT id_1, id_2, round(metres, 3) AS metres, round(2 * 6371.0 * asin(sqrt(k)), 6) AS km, round(north, 3) AS north, round(sqrt(greatest(0.0, metres * metres - north * north)), 3) AS east,
    round(abs(la - lb) + least(abs(lo - lp), 360 - abs(lo - lp)), 6) AS angular, round(sqrt(pow(abs(la - lb), 2) + pow(least(abs(lo - lp), 360 - abs(lo - lp)), 2)), 6) AS angular_l2,
    least(100000.0, round_even(exp(round_even(ln(metres + 1), 1) - 0.5) / 10, 0) * 10) AS dist_step, round(least(800.0, exp(round_even(ln(1 + metres / 50000), 1)) - 1), 6) AS dist_r1,
    CASE WHEN abs(lo + lp) < 0.1 AND abs(la - lb) < 0.1 AND abs(lo - lp) > 1 THEN -lp ELSE lp END AS repaired FROM m"""
)
def geo_distances(spark: SparkSession, d: str) -> DataFrame:
    pairs = sorted_neighbours(customers(spark, d), "id", ["country"], ["id"], 1, ["latitude", "longitude"])
    at = [F.col(f"{c}_{i}") for i in (1, 2) for c in ("latitude", "longitude")]
    pairs = pairs.withColumn("metres", geo.coarse_metres(*at))
    north, east = geo.north_and_east(F.col("metres"), at[0], at[2])
    return pairs.select("id_1", "id_2", F.round("metres", 3).alias("metres"), F.round(geo.haversine_km(*at), 6).alias("km"), F.round(north, 3).alias("north"), F.round(east, 3).alias("east"), F.round(geo.angle(*at), 6).alias("angular"), F.round(geo.angle(*at, squared=True), 6).alias("angular_l2"), geo.distance_step(F.col("metres")).alias("dist_step"), F.round(geo.median_ratio(F.col("metres"), F.lit(50000)), 6).alias("dist_r1"), geo.other_hemisphere(at[1], at[3], at[0], at[2]).alias("repaired"))


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice / (l_discount + 0.1) <= 100000 THEN l_extendedprice / (l_discount + 0.1) ELSE 100000 END, 4) AS ratio, round(least(l_quantity, 25), 4) AS quantity_capped, round(l_linenumber / greatest(1, l_suppkey), 2) AS r4 FROM lineitem"""
)
def ratio_caps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(geo.capped_ratio(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("ratio"), F.round("l_quantity", 4).alias("quantity_capped"), features.ratio(F.col("l_linenumber"), F.col("l_suppkey")).alias("r4"))
    return features.capped(rows, {"quantity_capped": 25.0})


@query(
    f"""WITH {_PARTS} SELECT id_1, id_2, levenshtein(x, y) AS name_ld, length(x) AS name_ll1, CASE WHEN length(x) >= 4 AND length(y) >= 4 AND (contains(x, left(y, 4)) OR contains(y, left(x, 4))) THEN 1 ELSE 0 END AS name_pi1,
    {_OVERLAP.format('left')} AS name_pi, {_OVERLAP.format('right')} AS name_pi2, round(length(x) / greatest(1, length(y)), 2) AS name_r3, CASE WHEN length(x) >= 5 AND left(x, 5) = left(y, 5) THEN 1 ELSE 0 END AS name_m5, round(levenshtein(lower(x), lower(y)) / greatest(length(x), length(y)), 6) AS name_levenshtein FROM q"""
)
def pair_features_l1(spark: SparkSession, d: str) -> DataFrame:
    pairs = part_pairs(spark, d).select("id_1", "id_2")
    found = features.pair_features(pairs, parts(spark, d), "id", ["name", "category"])
    return found.select("id_1", "id_2", "name_ld", "name_ll1", "name_pi1", "name_pi", "name_pi2", "name_r3", "name_m5", F.round("name_levenshtein", 6).alias("name_levenshtein"))


@query()
def pair_features_l2(spark: SparkSession, d: str) -> DataFrame:
    """All text and place features of neighbouring customers, with the kernels, codes and caps."""
    people = customers(spark, d)
    pairs = sorted_neighbours(people, "id", ["country"], ["id"], 2).select("id_1", "id_2")
    found = features.pair_features(pairs, people, "id", ["name", "segment"], place=True, kernels=True)
    codes = people.select("id", (F.col("country") % 3 + 1).alias("lang"), F.col("country").alias("category"))
    both = features.sides(found, codes, "id", ["lang", "category"])
    return features.capped(both.select(*found.columns, *features.combined_codes("lang", "category")), {"name_ll1": 20, "name_lcs": 16})
