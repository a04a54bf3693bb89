"""Queries of the candidate generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import geo, similarity, text
from samewise.operators import blocking, neighbours, tfidf
from samewise.plans.registry import query
from samewise.sources.tables import customers, named_documents, parts, suppliers, table

_CUSTOMER = "(SELECT c_custkey AS id, c_name AS name, c_nationkey AS country, c_mktsegment AS segment, (c_custkey * 7919 % 18000) / 100 - 90 AS latitude, (c_custkey * 104729 % 36000) / 100 - 180 AS longitude FROM customer)"
_SUPPLIER = "(SELECT s_suppkey AS id, s_name AS name, s_nationkey AS country, (s_suppkey * 7919 % 18000) / 100 - 90 AS latitude, (s_suppkey * 104729 % 36000) / 100 - 180 AS longitude FROM supplier)"
_LONGEST = "coalesce(list_max(list_transform(range(1, length({a}) + 1), lambda i: coalesce(list_max(list_filter(range(1, length({a}) - i + 2), lambda n: contains({b}, substring({a}, i, n)))), 0))), 0)"


@query(
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn FROM part)
    SELECT DISTINCT least(a.p_partkey, b.p_partkey) AS id_1, greatest(a.p_partkey, b.p_partkey) AS id_2 FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 WHERE {_LONGEST.format(a='a.p_name', b='b.p_name')} >= 5"""
)
def sorted_neighbour_name(spark: SparkSession, d: str) -> DataFrame:
    pairs = blocking.sorted_neighbours(parts(spark, d), "id", ["brand"], ["name", "id"], 3, ["name"])
    return blocking.canonical(pairs.where(similarity.common_substring(F.col("name_1"), F.col("name_2")) >= 5))


@query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) AS rn FROM part)
    SELECT a.p_partkey AS id_1, b.p_partkey AS id_2 FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.rn = a.rn + 1 WHERE left(a.p_type, 4) = left(b.p_type, 4)"""
)
def sorted_neighbour_prefix(spark: SparkSession, d: str) -> DataFrame:
    pairs = blocking.sorted_neighbours(parts(spark, d), "id", ["brand"], ["category", "id"], 1, ["category"])
    return pairs.where(similarity.same_beginning(F.col("category_1"), F.col("category_2"), 4) == 1).select("id_1", "id_2")


@query(
    f"""WITH c AS (SELECT id, country, floor(latitude) AS lat, row_number() OVER (PARTITION BY country ORDER BY floor(latitude), id) AS rn FROM {_CUSTOMER})
    SELECT a.id AS id_1, b.id AS id_2 FROM c a JOIN c b ON a.country = b.country AND b.rn BETWEEN a.rn + 1 AND a.rn + 20 AND a.lat = b.lat"""
)
def sorted_neighbour_equal_value(spark: SparkSession, d: str) -> DataFrame:
    rows = customers(spark, d).withColumn("lat", F.floor("latitude"))
    return blocking.sorted_neighbours(rows, "id", ["country"], ["lat", "id"], 20, ["lat"]).where("lat_1 = lat_2").select("id_1", "id_2")


@query(
    f"""WITH s AS (SELECT id, country, a, b, floor(latitude / 12.0 + a) AS y, floor(longitude / 12.0 + b) AS x FROM {_CUSTOMER}, (VALUES (0.0), (0.5)) s(a), (VALUES (0.0), (0.5)) t(b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, b, country, y, x ORDER BY id) AS rn FROM s)
    SELECT DISTINCT least(p.id, q.id) AS id_1, greatest(p.id, q.id) AS id_2 FROM r p JOIN r q ON p.a = q.a AND p.b = q.b AND p.country = q.country AND p.y = q.y AND p.x = q.x AND q.rn BETWEEN p.rn + 1 AND p.rn + 4"""
)
def grid_shift_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocking.shifted_grid(customers(spark, d), "id", F.col("latitude"), F.col("longitude"), 12.0, ["country"], 4)


@query(
    f"""WITH q AS MATERIALIZED (SELECT a.p_partkey AS id_1, b.p_partkey AS id_2, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size % 10 = b.p_size % 10 WHERE a.p_partkey < b.p_partkey)
    SELECT id_1, id_2 FROM q WHERE {_LONGEST.format(a='x', b='y')} >= 5"""
)
def cell_name_block(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d).withColumn("cell", F.col("size") % 10)
    pairs = blocking.cell_pairs(rows, "id", ["brand", "cell"], 300, ["name"])
    longest = similarity.kernel("int", similarity.longest_substring)(F.col("name_1"), F.col("name_2"))
    return pairs.withColumn("lcs2", longest).where("lcs2 >= 5").select("id_1", "id_2")


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY country, latitude, id) - 1 AS rn, count(*) OVER () AS n FROM {_SUPPLIER})
    SELECT a.id AS id_1, b.id AS id_2, t.shift FROM s a, (VALUES (1), (2), (5), (14)) t(shift) JOIN s b ON b.rn = (a.rn + t.shift) % a.n"""
)
def circular_shift_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = blocking.ranked(suppliers(spark, d), ["country", "latitude", "id"])
    return blocking.circular_shifts(rows, "id", "rank", suppliers(spark, d).count(), [1, 2, 5, 14])


@query()
def circular_shift_rules(spark: SparkSession, d: str) -> DataFrame:
    """All shifts of W10-W13 on customers, with the segment as category and usual distances that are the same for each."""
    return blocking.shifted_pairs(customers(spark, d).withColumnRenamed("segment", "category").withColumn("q90", F.lit(100.0)).withColumn("q99", F.lit(1000.0)))


@query(
    """WITH d AS (SELECT doc_id AS id, text AS name, right(regexp_replace(text, '[^0-9]', '', 'g'), 10) AS phone, CASE WHEN coalesce(text, '') = '' THEN '' ELSE text || '-' || lang END AS address FROM documents),
    b AS (SELECT id, name AS v, 'n' AS k, 25 AS most FROM d UNION ALL SELECT id, phone, 'p', 10 FROM d UNION ALL SELECT id, address, 'a', 10 FROM d), r AS (SELECT k, v FROM b WHERE v <> '' GROUP BY k, v, most HAVING count(*) > 1 AND count(*) <= most)
    SELECT DISTINCT x.id AS id_1, y.id AS id_2 FROM b x JOIN r USING (k, v) JOIN b y USING (k, v) WHERE x.id < y.id"""
)
def bucket_pairs_capped_whole(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by whole texts, by the last digits of whole texts, and by text and language."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.right(F.regexp_replace(F.col("text"), "[^0-9]", ""), F.lit(10)).alias("phone"), text.address_key(F.col("text"), F.col("lang")).alias("address"))
    return blocking.bucket_pairs(rows, "id", {"name": 25, "phone": 10, "address": 10})


@query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r1, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r2, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r3 FROM part),
    u AS (SELECT a.p_partkey AS x, b.p_partkey AS y FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.r1 = a.r1 + 1 UNION ALL SELECT a.p_partkey, b.p_partkey FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.r2 = a.r2 + 1),
    k AS (SELECT a.p_partkey AS x, b.p_partkey AS y FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.r3 = a.r3 + 1)
    SELECT DISTINCT least(x, y) AS id_1, greatest(x, y) AS id_2 FROM u WHERE x <> y EXCEPT SELECT x, y FROM k"""
)
def pair_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    by_name, by_size, by_id = (blocking.sorted_neighbours(rows, "id", ["brand"], [*order, "id"], 1).select("id_1", "id_2") for order in (["name"], ["size"], []))
    return blocking.not_in(blocking.canonical(by_name.unionByName(by_size)), by_id)


@query(
    """WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')) AS term FROM documents), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM c GROUP BY term), w AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN df USING (term)),
    n AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)
    SELECT a.id AS id_1, b.id AS id_2, round(sum(a.w * b.w), 5) AS sim FROM n a JOIN n b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.45"""
)
def tfidf_neighbours_whole(spark: SparkSession, d: str) -> DataFrame:
    """Alike texts by all their terms."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), "lang")
    return tfidf.alike(docs, "id", tfidf.words(F.col("name")), 0.45, order=[F.col("lang"), F.length("name")]).withColumn("sim", F.round("sim", 5))


@query(
    f"""WITH m AS (SELECT a.id AS id_1, b.id AS id_2, sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)) AS dist FROM {_CUSTOMER} a JOIN {_CUSTOMER} b ON a.segment = b.segment AND a.id <> b.id AND abs(a.latitude - b.latitude) <= 10 AND abs(a.longitude - b.longitude) <= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY id_1 ORDER BY dist, id_2) AS nth FROM m WHERE dist <= 10) SELECT id_1, id_2, round(dist, 6) AS distance, nth FROM r WHERE nth <= 5"""
)
def geo_knn(spark: SparkSession, d: str) -> DataFrame:
    near = blocking.nearest_places(customers(spark, d), "id", "latitude", "longitude", ["segment"], 5, 10.0)
    return near.withColumn("distance", F.round("distance", 6))


@query(
    f"""SELECT c.id, count(CASE WHEN q <= 1 THEN 1 END) AS n_0, count(CASE WHEN q <= 25 THEN 1 END) AS n_1, count(CASE WHEN q <= 100 THEN 1 END) AS n_2
    FROM {_CUSTOMER} c LEFT JOIN (SELECT a.id, pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2) AS q FROM {_CUSTOMER} a JOIN {_SUPPLIER} b ON abs(a.latitude - b.latitude) <= 10) m ON c.id = m.id GROUP BY c.id"""
)
def radius_counts(spark: SparkSession, d: str) -> DataFrame:
    return blocking.radius_counts(customers(spark, d), "id", suppliers(spark, d), "latitude", "longitude", [1.0, 5.0, 10.0])


@query(
    """WITH p AS (SELECT a.vec_id AS id_1, b.vec_id AS id_2, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id_1 ORDER BY sim DESC, id_2) AS nth FROM p) SELECT id_1, id_2, sim, nth FROM r WHERE nth <= 10"""
)
def embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors for each vector whose id is divisible by 50."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return neighbours.nearest_vectors(vectors, "id % 50 = 0", 10)


@query(
    """WITH d AS (SELECT doc_id AS id, lang, source, right(regexp_replace(text, '[^0-9]', '', 'g'), 10) AS phone FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY phone, source, id) AS rn FROM d WHERE phone <> '')
    SELECT a.id AS id_1, b.id AS id_2 FROM r a JOIN r b ON a.lang = b.lang AND b.rn BETWEEN a.rn + 1 AND a.rn + 10 WHERE left(a.phone, 7) = left(b.phone, 7) AND length(a.phone) >= 7"""
)
def sorted_neighbour_digits_whole(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by the last ten digits of whole texts that begin alike."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.right(F.regexp_replace(F.col("text"), "[^0-9]", ""), F.lit(10)).alias("phone")).where("phone <> ''")
    pairs = blocking.sorted_neighbours(rows, "id", ["lang"], ["phone", "source", "id"], 10, ["phone"])
    return pairs.where(similarity.same_beginning(F.col("phone_1"), F.col("phone_2"), 7) == 1).select("id_1", "id_2")


@query()
def sorted_neighbour_subsequence(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by phone digits with a common subsequence of seven."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", text.phone(F.col("text")).alias("phone")).where("phone <> ''")
    pairs = blocking.sorted_neighbours(rows, "id", ["lang"], ["phone", "id"], 10, ["phone"])
    return pairs.where(similarity.kernel("int", similarity.longest_subsequence)(F.col("phone_1"), F.col("phone_2")) >= 7).select("id_1", "id_2")


@query()
def sorted_neighbour_url(spark: SparkSession, d: str) -> DataFrame:
    """Next url of a host with common blocks of three characters of together seven."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), text.url(F.col("url")).alias("url"), F.regexp_extract("url", "//([^/]*)", 1).alias("host")).where("url <> ''")
    pairs = blocking.sorted_neighbours(rows, "id", ["host"], ["url", "id"], 1, ["url"])
    return pairs.where(similarity.kernel("int", lambda a, b: similarity.common_blocks(a, b, 3)[1])(F.col("url_1"), F.col("url_2")) >= 7).select("id_1", "id_2")


@query(
    f"""WITH d AS (SELECT doc_id AS id, lang, lower(left(text, 30)) AS address FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY address, id) AS rn FROM d WHERE address <> '')
    SELECT a.id AS id_1, b.id AS id_2 FROM r a JOIN r b ON a.lang = b.lang AND b.rn BETWEEN a.rn + 1 AND a.rn + 6 WHERE {_LONGEST.format(a='a.address', b='b.address')} >= 6"""
)
def sorted_neighbour_address(spark: SparkSession, d: str) -> DataFrame:
    rows = named_documents(spark, d).select("id", "lang", F.lower(F.left("name", F.lit(30))).alias("address")).where("address <> ''")
    pairs = blocking.sorted_neighbours(rows, "id", ["lang"], ["address", "id"], 6, ["address"])
    return pairs.where(similarity.common_substring(F.col("address_1"), F.col("address_2")) >= 6).select("id_1", "id_2")


@query(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY id) AS rn FROM {_CUSTOMER} WHERE segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')),
    p AS (SELECT a.id AS id_1, b.id AS id_2, a.segment = b.segment AS same, right(a.name, 7) = right(b.name, 7) OR left(a.name, 17) = left(b.name, 17) AS name_ok, 2 * 6371.0 * asin(sqrt(pow(sin((b.latitude - a.latitude) * (pi() / 180) / 2), 2) + cos(a.latitude * (pi() / 180)) * cos(b.latitude * (pi() / 180)) * pow(sin((b.longitude - a.longitude) * (pi() / 180) / 2), 2))) AS km FROM c a JOIN c b ON a.country = b.country AND b.rn BETWEEN a.rn + 1 AND a.rn + 3)
    SELECT id_1, id_2, round(km, 3) AS km FROM p WHERE km < 2000 OR name_ok OR (same AND km < 9000)"""
)
def shift_accept_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = customers(spark, d).where(F.col("segment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"))
    pairs = blocking.sorted_neighbours(rows, "id", ["country"], ["id"], 3, ["segment", "name", "latitude", "longitude"])
    km = geo.haversine_km(*[F.col(f"{c}_{i}") for i in (1, 2) for c in ("latitude", "longitude")])
    name_ok = (F.right("name_1", F.lit(7)) == F.right("name_2", F.lit(7))) | (F.left("name_1", F.lit(17)) == F.left("name_2", F.lit(17)))
    return pairs.withColumn("km", km).where((F.col("km") < 2000) | name_ok | ((F.col("segment_1") == F.col("segment_2")) & (F.col("km") < 9000))).select("id_1", "id_2", F.round("km", 3).alias("km"))
