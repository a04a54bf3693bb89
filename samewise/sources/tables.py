"""Reading and writing tables: Parquet, typed CSV, JSON, and the entity views over the standard tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

LIMITS = {ByteType: (-(2**7), 2**7 - 1), ShortType: (-(2**15), 2**15 - 1), IntegerType: (-(2**31), 2**31 - 1), LongType: (-(2**63), 2**63 - 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV with a header; quoted fields may hold line breaks. Null strings become empty."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def clipped(df: DataFrame, types: Mapping[str, DataType]) -> DataFrame:
    """Columns cast to their types, values beyond a type's range to its nearest."""
    out = {}
    for name, kind in types.items():
        c = F.col(name)
        if type(kind) in LIMITS:
            low, high = LIMITS[type(kind)]
            c = F.least(F.greatest(c, F.lit(low)), F.lit(high))
        out[name] = c.cast(kind)
    return df.withColumns(out)


def narrow_types(df: DataFrame) -> dict[str, DataType]:
    """For each whole-number column the narrowest type that holds its least and greatest value; for doubles, floats."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType))]
    out: dict[str, DataType] = {f.name: FloatType() for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    if whole:
        row = df.agg(*[x for c in whole for x in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))]).first()
        for c in whole:
            low, high = row[f"{c}_low"] or 0, row[f"{c}_high"] or 0
            out[c] = next(k() for k, (a, b) in LIMITS.items() if a <= low and high <= b)
    return out


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of a key: for debugging, the same each time."""
    return df.orderBy(key).limit(n)


def half(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Half of the rows at random, the same ones each time: those of an even hash of key and seed."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2)) == 0)


def with_last(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns moved to the end, in the given order."""
    return df.select(*[c for c in df.columns if c not in columns], *columns)


def numbered(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Adds numbers that rise in the order in which rows are read; in_order() brings rows back to it."""
    return df.withColumn(name, F.monotonically_increasing_id())


def in_order(df: DataFrame, name: str = "row_number") -> DataFrame:
    return df.orderBy(name).drop(name)


def rounded(df: DataFrame, places: Mapping[str, int]) -> DataFrame:
    """Numbers to so many places, halves to the even neighbour."""
    return df.withColumns({c: F.bround(c, n) for c, n in places.items()})


def literal_list(c: Column) -> Column:
    """Text such as ['a', 'b c'] as an array of texts; empty for other text."""
    items = F.regexp_extract_all(c, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    return F.when(c.rlike(r"^\s*\[.*\]\s*$"), F.transform(items, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(F.array().cast("array<string>"))


def write_matrix(df: DataFrame, key: str, vector: str, path: str) -> None:
    """A dense matrix as Parquet rows of (key, array of floats)."""
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> dict[str, object]:
    """A small dictionary in one JSON object, for parameters such as synonyms; larger ones are tables."""
    row = spark.read.json(path, multiLine=True).first()
    return {} if row is None else row.asDict(recursive=True)


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, lang, source): documents with the first 76 characters as name."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(76)).alias("name"), "lang", "source")


def placed(df: DataFrame, key: str) -> DataFrame:
    """Adds latitude and longitude, computed from the key."""
    return df.withColumn("latitude", F.col(key) * 7919 % 18000 / 100 - 90).withColumn("longitude", F.col(key) * 104729 % 36000 / 100 - 180)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, country, segment, latitude, longitude) of customers."""
    return placed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("segment")), "id")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("country")), "id")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, brand, category, size) of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"))
