"""Queries of joins, aggregates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, FloatType, IntegerType, ShortType

from samewise.functions import geo
from samewise.operators import evaluate
from samewise.operators.blocking import sorted_neighbours
from samewise.plans.registry import query
from samewise.sources.tables import clipped, customers, narrow_types, parts, table

STEP = "CAST(floor(exp(round_even(ln(least({0}, 10000) + 1), 1)) - 0.5) AS BIGINT)"


@query(
    """WITH g AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS m_true, count(*) AS n, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY o_custkey HAVING count(*) > 1)
    SELECT o_custkey AS poi, m_true, n, statuses, CAST(sum(n) OVER () AS BIGINT) AS ids_in_groups FROM g"""
)
def truth_strings(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), " ")
    groups = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("poi")).agg(ids.alias("m_true"), F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("statuses")).where("n > 1")
    return groups.crossJoin(F.broadcast(groups.agg(F.sum("n").alias("ids_in_groups"))))  # one row


@query(
    f"""WITH v AS (SELECT v, count(*) AS n FROM (SELECT l_partkey AS v FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY v)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {STEP.format('least(a.n, b.n)')} AS cc_min, {STEP.format('greatest(a.n, b.n)')} AS cc_max
    FROM lineitem JOIN v a ON a.v = l_partkey JOIN v b ON b.v = l_suppkey"""
)
def count_encoding(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.count_encoding(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query(
    """WITH c AS (SELECT n_nationkey AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
    SELECT nation, n, least(10, row_number() OVER (ORDER BY n DESC, nation)) AS country FROM c"""
)
def country_rank_cap(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    n = orders.join(customers(spark, d).select("id", "country"), "id").groupBy(F.col("country").alias("nation")).agg(F.count("*").alias("n"))
    return n.withColumn("country", F.least(F.lit(10), F.row_number().over(Window.orderBy(F.desc("n"), "nation"))))  # as many rows as countries


@query(
    """WITH p AS (SELECT l_partkey, p_type, p_brand, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
    s AS (SELECT least(a.p_type, b.p_type) AS c1, greatest(a.p_type, b.p_type) AS c2, a.l_orderkey FROM (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) a JOIN (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) b ON a.l_orderkey = b.l_orderkey AND a.p_type < b.p_type),
    link AS (SELECT c1, c2, count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS ratio FROM s GROUP BY c1, c2),
    pairs AS (SELECT a.p_partkey AS id_1, b.p_partkey AS id_2, [a.p_type, CASE WHEN a.p_size % 2 = 0 THEN 'SMALL' ELSE 'LARGE' END] AS x, [b.p_type] AS y FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) a JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) b ON a.p_brand = b.p_brand AND b.rn = a.rn + 1),
    e AS (SELECT id_1, id_2, unnest(x) AS p, y[1] AS q FROM pairs)
    SELECT id_1, id_2, round(max(coalesce(ratio, 0)), 6) AS cat_link_score FROM e LEFT JOIN link ON c1 = least(p, q) AND c2 = greatest(p, q) GROUP BY id_1, id_2"""
)
def category_pair_link(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"))
    kinds = lines.join(parts(spark, d).select("id", "category"), "id").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("category")).alias("kinds"))  # a handful in an order
    total = kinds.agg(F.count("*").alias("orders"))
    pairs = kinds.select(F.explode("kinds").alias("c1"), "kinds").select("c1", F.explode("kinds").alias("c2")).where("c1 < c2")
    link = pairs.groupBy("c1", "c2").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("c1", "c2", (F.col("n") / F.col("orders")).alias("ratio"))
    rows = parts(spark, d).withColumn("labels", F.array("category", F.when(F.col("size") % 2 == 0, "SMALL").otherwise("LARGE")))
    sides = sorted_neighbours(rows, "id", ["brand"], ["id"], 1, ["labels", "category"])
    met = sides.select("id_1", "id_2", F.explode("labels_1").alias("p"), F.col("category_2").alias("q")).select("id_1", "id_2", F.least("p", "q").alias("c1"), F.greatest("p", "q").alias("c2"))
    return met.join(link, ["c1", "c2"], "left").groupBy("id_1", "id_2").agg(F.round(F.max(F.coalesce("ratio", F.lit(0.0))), 6).alias("cat_link_score"))


_CUSTOMER = "(SELECT c_custkey AS id, c_name AS name, c_nationkey AS country, c_mktsegment AS segment, (c_custkey * 7919 % 18000) / 100 - 90 AS latitude, (c_custkey * 104729 % 36000) / 100 - 180 AS longitude FROM customer)"
_METRES = "2 * 6373000.0 * atan2(sqrt(h), sqrt(1 - h))"


@query(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY id) AS rn FROM {_CUSTOMER}),
    p AS (SELECT a.segment, pow(sin((b.latitude - a.latitude) * (3.14 / 180) / 2), 2) + cos(a.latitude * (3.14 / 180)) * cos(b.latitude * (3.14 / 180)) * pow(sin((b.longitude - a.longitude) * (3.14 / 180) / 2), 2) AS h FROM c a JOIN c b ON a.segment = b.segment AND b.rn = a.rn + 1)
    SELECT segment, count(*) AS n, round(avg(m), 3) AS mean, round(quantile_cont(m, 0.25), 3) AS q25, round(quantile_cont(m, 0.5), 3) AS q50, round(quantile_cont(m, 0.75), 3) AS q75, round(quantile_cont(m, 0.9), 3) AS q90, round(quantile_cont(m, 0.99), 3) AS q99
    FROM (SELECT segment, {_METRES} AS m FROM p) GROUP BY segment"""
)
def category_distance_quantiles(spark: SparkSession, d: str) -> DataFrame:
    pairs = sorted_neighbours(customers(spark, d), "id", ["segment"], ["id"], 1, ["segment", "latitude", "longitude"])
    metres = geo.coarse_metres(*[F.col(f"{c}_{i}") for i in (1, 2) for c in ("latitude", "longitude")])
    q = F.percentile("m", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.99)]))
    found = pairs.select(F.col("segment_1").alias("segment"), metres.alias("m")).groupBy("segment").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), q.alias("q"))
    return found.select("segment", "n", F.round("mean", 3).alias("mean"), *[F.round(F.col("q")[i], 3).alias(f"q{n}") for i, n in enumerate((25, 50, 75, 90, 99))])


@query(
    """WITH s AS (SELECT p_type AS label, count(*) / (SELECT count(*) FROM part) AS score FROM part GROUP BY p_type), r AS (SELECT p_partkey AS id, [p_type, CASE WHEN p_size % 2 = 0 THEN 'SMALL' ELSE 'LARGE' END] AS labels FROM part)
    SELECT id, round(max(score), 6) AS cat_solo_score FROM (SELECT id, unnest(labels) AS label FROM r) JOIN s USING (label) GROUP BY id"""
)
def solo_category_score(spark: SparkSession, d: str) -> DataFrame:
    rows = parts(spark, d)
    n = rows.agg(F.count("*").alias("total"))
    scores = rows.groupBy(F.col("category").alias("label")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("label", (F.col("n") / F.col("total")).alias("score"))
    labels = rows.select("id", F.explode(F.array("category", F.when(F.col("size") % 2 == 0, "SMALL").otherwise("LARGE"))).alias("label"))
    return labels.join(scores, "label").groupBy("id").agg(F.round(F.max("score"), 6).alias("cat_solo_score"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem")
def feature_correlation(spark: SparkSession, d: str) -> DataFrame:
    pairs = {"quantity_price": ("l_quantity", "l_extendedprice"), "quantity_discount": ("l_quantity", "l_discount"), "price_tax": ("l_extendedprice", "l_tax")}
    return table(spark, d, "lineitem").agg(*[F.round(F.corr(a, b), 6).alias(n) for n, (a, b) in pairs.items()])


@query(
    """SELECT l_orderkey, l_linenumber, CAST(least(greatest(l_partkey, -128), 127) AS TINYINT) AS part_byte, CAST(least(greatest(l_orderkey * 7, -32768), 32767) AS SMALLINT) AS order_short,
    CAST(least(greatest(trunc(l_extendedprice), -2147483648), 2147483647) AS INT) AS price_int, CAST(l_discount AS FLOAT) AS discount FROM lineitem"""
)
def typed_scan_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_byte"), (F.col("l_orderkey") * 7).alias("order_short"), F.col("l_extendedprice").alias("price_int"), F.col("l_discount").alias("discount"))
    return clipped(rows, {"part_byte": ByteType(), "order_short": ShortType(), "price_int": IntegerType(), "discount": FloatType()})


@query(
    """SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber']) AS name, unnest([CASE WHEN max(l_orderkey) < 128 THEN 'byte' WHEN max(l_orderkey) < 32768 THEN 'short' ELSE 'integer' END,
    CASE WHEN max(l_partkey) < 128 THEN 'byte' WHEN max(l_partkey) < 32768 THEN 'short' ELSE 'integer' END, CASE WHEN max(l_suppkey) < 128 THEN 'byte' WHEN max(l_suppkey) < 32768 THEN 'short' ELSE 'integer' END, 'byte']) AS kind FROM lineitem"""
)
def narrowest_types(spark: SparkSession, d: str) -> DataFrame:
    found = narrow_types(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return spark.createDataFrame([(n, k.typeName()) for n, k in found.items()], "name string, kind string")


@query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
    SELECT a.p_partkey AS id_1, b.p_partkey AS id_2, a.p_name AS name_1, b.p_name AS name_2, a.p_type AS category_1, b.p_type AS category_2, n_name AS nation, CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END AS y
    FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.rn = a.rn + 1 LEFT JOIN nation ON n_nationkey = a.p_size"""
)
def attach_sides(spark: SparkSession, d: str) -> DataFrame:
    from samewise.operators.features import sides

    pairs = sorted_neighbours(parts(spark, d), "id", ["brand"], ["id"], 1).select("id_1", "id_2")
    both = sides(pairs, parts(spark, d), "id", ["name", "category", "size"])
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("size_1"), F.col("n_name").alias("nation"))
    return both.join(nations, "size_1", "left").select("id_1", "id_2", "name_1", "name_2", "category_1", "category_2", "nation", (F.col("category_1") == F.col("category_2")).cast("int").alias("y"))


@query(
    """SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS smallest, greatest(l_discount, l_tax) AS largest, round((l_discount + l_tax + l_quantity) / 3, 6) AS mean FROM lineitem"""
)
def rowwise_extremes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").drop("l_shipdate", "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", F.least("l_discount", "l_tax").alias("smallest"), F.greatest("l_discount", "l_tax").alias("largest"), F.round((F.col("l_discount") + F.col("l_tax") + F.col("l_quantity")) / 3, 6).alias("mean"))


@query(
    """SELECT l_partkey AS id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS positives, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers FROM lineitem GROUP BY l_partkey"""
)
def positives_per_id(spark: SparkSession, d: str) -> DataFrame:
    suppliers = F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",")
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "R").alias("positives"), suppliers.alias("suppliers"))


@query(
    """WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS a FROM orders GROUP BY o_custkey), p AS (SELECT x.o_custkey AS id, x.a AS a, y.a AS b FROM g x JOIN g y ON y.o_custkey = x.o_custkey + 1)
    SELECT id, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS together, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS iou FROM p"""
)
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("a"))
    both = sets.join(sets.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return both.select("id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("together"), F.round(evaluate.set_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total, max(CAST(json_extract_string(props, '$.k') AS INT)) AS greatest_k FROM events GROUP BY user_id, event_type")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("k").alias("greatest_k"))
