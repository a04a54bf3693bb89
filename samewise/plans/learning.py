"""Queries of folds and learnt scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators import evaluate, ml
from samewise.plans.registry import query
from samewise.sources.tables import table

CHEAP = ["n_chars", "spaces"]
FULL = [*CHEAP, "signs", "capitals", "words", "lines"]


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with simple measures of their text, the quality label and a fold of their source."""
    text = F.col("text")
    n = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return rows.select("doc_id", "y", "n_chars", n("[^ ]").alias("spaces"), n("[^!#$%&*|]").alias("signs"), n("[^A-Z]").alias("capitals"), F.size(F.split(text, " ")).alias("words"), n("[^\n]").alias("lines"), ml.fold(F.col("source"), 3).alias("fold"))


@query("SELECT doc_id, doc_id // 10 % 5 AS fold, CASE WHEN quality = toxic THEN 1 ELSE 0 END AS y FROM labels")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds of groups of ten ids: all of a group in one."""
    return table(spark, d, "labels").select("doc_id", (F.floor(F.col("doc_id") / 10) % 5).alias("fold"), (F.col("quality") == F.col("toxic")).cast("int").alias("y"))


@query()
def gbt_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of a cheap model and of the cascade, out of fold."""
    scored = ml.cascade(labelled_documents(spark, d), CHEAP, FULL, "y", "fold", 3, trees=6)
    return evaluate.roc_auc(scored, "level_1").select(F.round("auc", 4).alias("auc_level_1")).crossJoin(evaluate.roc_auc(scored).select(F.round("auc", 4).alias("auc")))  # one row each


@query()
def fold_importance_mean(spark: SparkSession, d: str) -> DataFrame:
    _, models = ml.out_of_fold(labelled_documents(spark, d), FULL, "y", "fold", 3, trees=5)
    return spark.createDataFrame([(f, round(v, 6)) for f, v in ml.importance(models, FULL)], "feature string, importance double")
