"""Folds, boosted-tree scoring in folds, and the cascade of a cheap and a full model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(group: Column, k: int) -> Column:
    """Fold of a group: rows of one group stay together, whatever their number."""
    return F.pmod(F.xxhash64(group), F.lit(k)).cast("int")


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, folds: str, k: int, trees: int = 20, depth: int = 4, step: float = 0.1, stop_early: bool = False) -> tuple[DataFrame, list[GBTClassificationModel]]:
    """df with score: each row's from the model that did not see its fold. Also the models.

    A fold whose training rows have one label only scores with that label's share. With stop_early the next fold's rows are not
    learnt from but watched: no more trees are added once their error no longer falls.
    """
    rows = assembled(df, features)
    out, models = [], []
    for i in range(k):
        train, rest = rows.where(F.col(folds) != i), rows.where(F.col(folds) == i)
        seen = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
        if len(seen) < 2:
            out.append(rest.withColumn("score", F.lit(float(next(iter(seen), 0)))))
            continue
        learner = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=42 + i)
        if stop_early:
            watched = F.col(folds) == (i + 1) % k
            both = {bool(r["w"]) for r in train.where(watched.isNotNull()).groupBy(watched.alias("w")).agg(F.count_distinct(label).alias("n")).where("n > 1").collect()}
            if both == {True, False}:  # otherwise nothing can be learnt or watched
                train = train.withColumn("_watched", watched)
                learner.setParams(validationIndicatorCol="_watched", validationTol=0.0)
        model = learner.fit(train)
        models.append(model)
        out.append(model.transform(rest).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction"))
    return reduce(DataFrame.unionByName, out).drop("features"), models


def ensemble(df: DataFrame, features: Sequence[str], models: Sequence[GBTClassificationModel]) -> DataFrame:
    """df with score, the mean of the models' probabilities."""
    rows = assembled(df, features)
    for i, m in enumerate(models):
        rows = m.transform(rows).withColumn(f"_s{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return rows.withColumn("score", sum((F.col(f"_s{i}") for i in range(len(models))), F.lit(0.0)) / max(1, len(models))).drop("features", *[f"_s{i}" for i in range(len(models))])


def save_models(models: Sequence[GBTClassificationModel], path: str) -> None:
    """Models in folders of their places under a path that all executors reach."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/{i}")


def load_models(path: str, n: int) -> list[GBTClassificationModel]:
    """The first n models that save_models() wrote."""
    return [GBTClassificationModel.load(f"{path}/{i}") for i in range(n)]


def search(df: DataFrame, features: Sequence[str], label: str, folds: str, k: int, settings: Sequence[Mapping[str, float]]) -> list[tuple[dict[str, float], float]]:
    """Settings of out_of_fold() (trees, depth, step) with the area under the curve of their out-of-fold scores, best first; ties in the given order."""
    from samewise.operators.evaluate import roc_auc

    areas = [roc_auc(out_of_fold(df, features, label, folds, k, **s)[0], label=label).first()["auc"] for s in settings]
    return sorted(((dict(s), a if a is not None else 0.0) for s, a in zip(settings, areas)), key=lambda x: -x[1])


def importance(models: Sequence[GBTClassificationModel], features: Sequence[str]) -> list[tuple[str, float]]:
    """Mean importance of each feature over the folds' models."""
    return [(f, float(sum(m.featureImportances[i] for m in models)) / max(1, len(models))) for i, f in enumerate(features)]


def left_out(df: DataFrame, features: Sequence[str], label: str, folds: str, k: int, trees: int = 5) -> list[tuple[str, DataFrame]]:
    """For each feature, scores without it."""
    return [(f, out_of_fold(df, [g for g in features if g != f], label, folds, k, trees)[0]) for f in features]


def cascade(df: DataFrame, cheap: Sequence[str], full: Sequence[str], label: str, folds: str, k: int, keep_above: float = 0.0075, trees: int = 20) -> DataFrame:
    """Scores of a model of cheap features choose the rows that a model of all features scores: level_1 and score (level_1 where not chosen)."""
    from samewise.session import written

    first, _ = out_of_fold(df, cheap, label, folds, k, trees)
    first = written(first.withColumnRenamed("score", "level_1"), "level-1")
    second, _ = out_of_fold(first.where(F.col("level_1") > keep_above), full, label, folds, k, trees)
    rest = first.where(F.col("level_1") <= keep_above).withColumn("score", F.col("level_1"))
    return second.select(rest.columns).unionByName(rest)
