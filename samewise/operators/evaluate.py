"""Evaluation of candidates, scores and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.blocking import running_before
from samewise.session import written


def set_iou(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def cluster_iou(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, iou) from (id, cluster) and (id, truth): each id's predicted and true group; ids without prediction stand alone.

    Groups aren't built: the overlap of two groups is the number of ids they share.
    """
    both = truth.join(predicted, "id", "left").withColumn("cluster", F.when(F.col("cluster").isNull(), F.concat(F.lit("own-"), F.col("id"))).otherwise(F.concat(F.lit("c-"), F.col("cluster"))))
    shared = both.groupBy("cluster", "truth").agg(F.count("*").alias("common"))
    p, t = both.groupBy("cluster").agg(F.count("*").alias("np")), both.groupBy("truth").agg(F.count("*").alias("nt"))
    sized = shared.join(p, "cluster").join(t, "truth").withColumn("iou", F.col("common") / (F.col("np") + F.col("nt") - F.col("common")))
    return both.join(sized.select("cluster", "truth", "iou"), ["cluster", "truth"]).select("id", "iou")


def mean_iou(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, iou: the mean over all ids of truth."""
    return cluster_iou(predicted, truth).agg(F.avg("iou").alias("iou"))


def iou_by_threshold(scored: DataFrame, truth: DataFrame, thresholds: Sequence[float] = (0.4, 0.45, 0.5, 0.55, 0.6, 0.65), tie: float = 0.8) -> DataFrame:
    """(threshold, iou) of sweep clusters at each threshold; threshold 0 takes the true pairs (y = 1) alone, which is the most that these pairs can reach."""
    from samewise.operators.cluster import sweep_clusters

    pairs = scored.select("id_1", "id_2", "score")
    true_pairs = scored.where("y = 1").select("id_1", "id_2", F.lit(1.0).alias("score"))
    found = [mean_iou(sweep_clusters(true_pairs, 0.0, tie), truth).withColumn("threshold", F.lit(0.0))]
    found += [mean_iou(sweep_clusters(pairs, t, tie), truth).withColumn("threshold", F.lit(float(t))) for t in thresholds]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("threshold", "iou")


def threshold_table(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: pairs above it, matches among them, and shares of both."""
    table = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    rows = scored.select("score", "y", table)
    return rows.groupBy("threshold").agg(F.count_if(F.col("score") > F.col("threshold")).alias("kept"), F.count_if((F.col("score") > F.col("threshold")) & (F.col("y") == 1)).alias("matches"), F.count_if(F.col("y") == 1).alias("all_matches"))


def candidate_report(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: candidates, matches, share of matches, ids in matches, and the share of true pairs found."""
    a, b = (truth.select(F.col("id").alias(f"id_{i}"), F.col("truth").alias(f"t_{i}")) for i in (1, 2))
    labelled = pairs.join(a, "id_1").join(b, "id_2").withColumn("y", (F.col("t_1") == F.col("t_2")).cast("int"))
    found = labelled.agg(F.count("*").alias("candidates"), F.sum("y").alias("matches"), F.avg("y").alias("match_share"), F.count_distinct(F.when(F.col("y") == 1, F.col("id_1"))).alias("left_ids"))
    true_pairs = truth.groupBy("truth").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("true_pairs"))
    return found.crossJoin(true_pairs).withColumn("recall", F.when(F.col("true_pairs") > 0, F.col("matches") / F.col("true_pairs")))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """One row, auc: from counts at each different score, with ties at half.

    Scores are counted first; running counts are taken over ranges of scores, so that no task holds all of them.
    """
    per = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    # written once: range bounds are sampled anew each time a plan is run
    spread = written(per.repartitionByRange(score).withColumn("_part", F.spark_partition_id()), "scores")
    before = running_before(spread.groupBy("_part").agg(F.sum("q").alias("_q")), "_q")
    below = F.coalesce(F.sum("q").over(Window.partitionBy("_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = spread.withColumn("_below", below).join(F.broadcast(before), "_part")
    return ranked.agg((F.sum(F.col("p") * (F.col("_below") + F.col("_before") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def confusion(scored: DataFrame, predicted: Column, label: Column) -> DataFrame:
    return scored.groupBy(label.cast("int").alias("label"), predicted.cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def count_encoding(pairs: DataFrame, side_1: str, side_2: str, scale: float = 1.0, most: int = 10_000) -> DataFrame:
    """Adds cc_min and cc_max: how often each side's value occurs on both sides, smaller and larger, scaled, capped and in logarithmic steps."""
    values = pairs.select(F.explode(F.array(side_1, side_2)).alias("_v")).groupBy("_v").agg(F.count("*").alias("_n"))
    a, b = (values.select(F.col("_v").alias(s), F.col("_n").alias(f"_n{i}")) for i, s in ((1, side_1), (2, side_2)))
    step = lambda c: F.floor(F.exp(F.bround(F.ln(F.least(c * scale, F.lit(float(most))) + 1), 1)) - 0.5).cast("long")
    return pairs.join(a, side_1).join(b, side_2).withColumn("cc_min", step(F.least("_n1", "_n2"))).withColumn("cc_max", step(F.greatest("_n1", "_n2"))).drop("_n1", "_n2")
