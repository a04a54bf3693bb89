"""Session factory and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", app: str = "samewise", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; further settings by keyword, dots as double underscores.

    Only a local master gets a small number of shuffle partitions: adaptive execution joins partitions but doesn't split them, so
    a cluster's number is left to its own settings.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", "8")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session (tests) takes a temporary folder; a cluster's executors would not share one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="samewise-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/samewise/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._samewise_path = path
    _held(spark).add(path)
    return out


_LEFT: dict[str, set[str]] = {}


def _held(spark: SparkSession) -> set[str]:
    """Paths of written() that were not dropped; deleted when Python ends, as far as the session still runs."""
    app = spark.sparkContext.applicationId
    if app not in _LEFT:
        _LEFT[app] = set()
        atexit.register(_drop_left, spark, _LEFT[app])
    return _LEFT[app]


def _drop_left(spark: SparkSession, paths: set[str]) -> None:
    if spark.sparkContext._jsc is not None:
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the table that written() made; for tables that nothing reads any more."""
    _delete(df.sparkSession, df._samewise_path)
    _held(df.sparkSession).discard(df._samewise_path)
