"""The cleaning stage on streams: it keeps no state, so the same expressions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from samewise.functions import text


def cleaned(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds the normal name, its language class and initials."""
    name = F.left(F.col(column), F.lit(text.LENGTHS["name"]))
    return df.withColumns({"name_clean": text.without_stop_words(text.normal(name)), "language": text.language_class(name), "initials": text.initials(name)})


def clean_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, column: str = "text") -> StreamingQuery:
    """Cleans Parquet files as they come, all that are there, and stops."""
    stream = spark.readStream.schema(schema).parquet(source)
    return cleaned(stream, column).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
