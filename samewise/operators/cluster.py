"""Clusters from scored pairs.

The order of scores decides, so pairs are grouped by the component of those above the threshold: no cluster crosses
components, and each component is worked through by itself. Ties are broken by ids; a cluster is named by its smallest member.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.graph import components


def _parts(scored: DataFrame, threshold: float) -> DataFrame:
    above = scored.where(F.col("score") > threshold)
    return above.join(components(above, "id_1", "id_2").withColumnRenamed("id", "id_1"), "id_1")


def grow(pairs: list[tuple[int, int, float]], small: float, big: float) -> dict[int, int]:
    """Members' clusters, from pairs in falling order of score.

    A pair of two free ids founds a cluster; a free id joins the other's cluster if the score is above `small` for clusters of
    up to two, above `big` for larger ones; an id that may not join stays free.
    """
    cluster_of: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for a, b, score in pairs:
        inside = [x for x in (a, b) if x in cluster_of]
        if not inside:
            members[a] = [a, b]
            cluster_of[a] = cluster_of[b] = a
        elif len(inside) == 1:
            home = cluster_of[inside[0]]
            if score > (big if len(members[home]) > 2 else small):
                new = b if inside[0] == a else a
                cluster_of[new] = home
                members[home].append(new)
    return cluster_of


def merge(pairs: list[tuple[int, int, float]], cluster_of: dict[int, int], threshold: float, most: int) -> dict[int, int]:
    """Joins two clusters by a pair above the threshold while together they have at most `most` members; the older one's name stays."""
    members: dict[int, set[int]] = {}
    for x, home in cluster_of.items():
        members.setdefault(home, set()).add(x)
    age = {home: i for i, home in enumerate(dict.fromkeys(cluster_of.values()))}
    for a, b, score in pairs:
        if score <= threshold or a not in cluster_of or b not in cluster_of or cluster_of[a] == cluster_of[b]:
            continue
        old, young = sorted((cluster_of[a], cluster_of[b]), key=age.__getitem__)
        if len(members[old]) + len(members[young]) <= most:
            members[old] |= members.pop(young)
            cluster_of.update(dict.fromkeys(members[old], old))
    return cluster_of


def merge_by_scores(pairs: list[tuple[int, int, float]], cluster_of: dict[int, int], most_above: float, mean_above: float, most: int) -> dict[int, int]:
    """Joins two clusters by all scores between them: one above most_above, or two or more of a mean above mean_above.

    Pairs of clusters are looked at by age; a cluster's target is what its older partner is joined to by then (the last such partner
    counts). A join that would make more than `most` members is left out.
    """
    members: dict[int, set[int]] = {}
    for x, home in cluster_of.items():
        members.setdefault(home, set()).add(x)
    age = {home: i for i, home in enumerate(dict.fromkeys(cluster_of.values()))}
    between: dict[tuple[int, int], list[float]] = {}
    for a, b, score in pairs:
        x, y = cluster_of.get(a), cluster_of.get(b)
        if x is not None and y is not None and x != y and len(members[x]) + len(members[y]) <= most:
            between.setdefault((x, y) if age[x] < age[y] else (y, x), []).append(score)
    target: dict[int, int] = {}
    for old, young in sorted(between, key=lambda p: (age[p[0]], age[p[1]])):
        scores = between[old, young]
        if max(scores) > most_above or (len(scores) > 1 and sum(scores) / len(scores) > mean_above):
            target[young] = target.get(old, old)
    for young, old in target.items():
        if len(members[old]) + len(members[young]) <= most:
            cluster_of.update(dict.fromkeys(members[young], old))
            members[old] |= members[young]
            members[young] = set()
    return cluster_of


def without_outliers(pairs: list[tuple[int, int, float]], cluster_of: dict[int, int], below: float) -> dict[int, int]:
    """Members of clusters of three or more whose scores within it have a low mean become clusters of their own, named by themselves."""
    size, scores = {}, {}
    for home in cluster_of.values():
        size[home] = size.get(home, 0) + 1
    for a, b, score in pairs:
        if a in cluster_of and cluster_of[a] == cluster_of.get(b):
            for x in (a, b):
                scores.setdefault(x, []).append(score)
    alone = [x for x, home in cluster_of.items() if size[home] > 2 and x in scores and sum(scores[x]) / len(scores[x]) < below]
    return cluster_of | {x: ("alone", x) for x in alone}


def _named(cluster_of: dict[int, int]) -> pd.DataFrame:
    least: dict[int, int] = {}
    for x, home in cluster_of.items():
        least[home] = min(x, least.get(home, x))
    return pd.DataFrame({"id": list(cluster_of), "cluster": [least[h] for h in cluster_of.values()]}, dtype="int64")


def _ordered(pdf: pd.DataFrame) -> list[tuple[int, int, float]]:
    return list(pdf.sort_values(["score", "id_1", "id_2"], ascending=[False, True, True])[["id_1", "id_2", "score"]].itertuples(index=False, name=None))


def greedy_clusters(scored: DataFrame, small: float = 0.45, big: float = 0.6, merge_above: float | None = 0.6, most: int = 300, found: float | None = None) -> DataFrame:
    """(id, cluster) of scored pairs (id_1, id_2, score): grown, then merged (unless merge_above is None). A component of links must fit a task.

    Only pairs above `found` found clusters or join them; it is the lesser of small and big if it isn't given.
    """
    base = min(small, big) if found is None else found

    def work(pdf):
        pairs = _ordered(pdf)
        clusters = grow(pairs, small, big)
        return _named(merge(pairs, clusters, merge_above, most) if merge_above is not None else clusters)

    return _parts(scored, base).groupBy("component").applyInPandas(work, "id long, cluster long")


def improved_clusters(scored: DataFrame, found: float = 0.45, small: float = 0.6, big: float = 0.6, most_above: float = 0.9, mean_above: float = 0.0, most: int = 300, outliers_below: float | None = None) -> DataFrame:
    """(id, cluster) of scored pairs: grown, merged, and freed of outliers if outliers_below is given.

    With mean_above clusters are merged by all scores between them, else by single scores above most_above. Scores below `found` count for
    means too, so mean_above must not be less than `found`, else clusters of different components could be merged.
    """
    if 0 < mean_above < found:
        raise ValueError("mean_above must not be less than found")
    home = components(scored.where(F.col("score") > found), "id_1", "id_2")
    a, b = (home.select(F.col("id").alias(f"id_{i}"), F.col("component").alias(f"_home_{i}")) for i in (1, 2))
    inside = scored.select("id_1", "id_2", "score").join(a, "id_1").join(b, "id_2").where("_home_1 = _home_2").drop("_home_2")

    def work(pdf):
        pairs = _ordered(pdf)
        above = [p for p in pairs if p[2] > found]
        clusters = grow(above, small, big)
        clusters = merge_by_scores(pairs, clusters, most_above, mean_above, most) if mean_above > 0 else merge(above, clusters, most_above, most)
        return _named(without_outliers(pairs, clusters, outliers_below) if outliers_below is not None else clusters)

    return inside.groupBy("_home_1").applyInPandas(work, "id long, cluster long")


def sweep(pairs: list[tuple[int, int, float]], tie: float, sweeps: int = 20) -> dict[int, int]:
    """First touch, then sweeps: a pair's free id joins the other's cluster, two free ones found one; then both ids of a pair above `tie` go to the older of their clusters, until a sweep moves none."""
    home: dict[int, int] = {}
    made = 0
    for a, b, _ in pairs:
        if a in home:
            home[b] = home[a]
        elif b in home:
            home[a] = home[b]
        else:
            home[a] = home[b] = made
            made += 1
    for _ in range(sweeps):
        moved = False
        for a, b, score in pairs:
            if score > tie and home[a] != home[b]:
                home[a] = home[b] = min(home[a], home[b])
                moved = True
        if not moved:
            break
    return home


def sweep_clusters(scored: DataFrame, threshold: float = 0.45, tie: float = 0.8, sweeps: int = 20) -> DataFrame:
    """(id, cluster) by sweep() over pairs above the threshold. A component of links must fit a task."""

    def work(pdf):
        return _named(sweep(_ordered(pdf), tie, sweeps))

    return _parts(scored, threshold).groupBy("component").applyInPandas(work, "id long, cluster long")


def between_clusters(scored: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_1, cluster_2, most, mean, n) of scores between two clusters."""
    a = clusters.select(F.col("id").alias("id_1"), F.col("cluster").alias("c1"))
    b = clusters.select(F.col("id").alias("id_2"), F.col("cluster").alias("c2"))
    across = scored.join(a, "id_1").join(b, "id_2").where("c1 <> c2")
    return across.groupBy(F.least("c1", "c2").alias("cluster_1"), F.greatest("c1", "c2").alias("cluster_2")).agg(F.max("score").alias("most"), F.avg("score").alias("mean"), F.count("*").alias("n"))


def mergeable(between: DataFrame, most_above: float = 0.9, mean_above: float = 0.6) -> DataFrame:
    return between.where((F.col("most") > most_above) | ((F.col("mean") > mean_above) & (F.col("n") > 1)))


def outliers(scored: DataFrame, clusters: DataFrame, below: float = 0.25) -> DataFrame:
    """(id, cluster, mean, outlier): members of clusters of three or more whose mean score within it is low.

    Scores are added up as decimals, so a mean at the limit is not below it, in whatever order they come; those from 10^10 on and NaN as doubles.
    """
    a = clusters.select(F.col("id").alias("id_1"), F.col("cluster").alias("c1"))
    b = clusters.select(F.col("id").alias("id_2"), F.col("cluster").alias("c2"))
    inside = scored.join(a, "id_1").join(b, "id_2").where("c1 = c2")
    sides = inside.select(F.explode(F.array("id_1", "id_2")).alias("id"), F.col("c1").alias("cluster"), "score")
    exact = F.col("score").cast("double").try_cast("decimal(28,18)")
    total = F.when(F.count(exact) == F.count("score"), F.sum(exact).cast("double")).otherwise(F.sum(F.col("score").cast("double")))
    means = sides.groupBy("cluster", "id").agg((total / F.count("score")).alias("mean"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return means.join(size, "cluster").select("id", "cluster", "mean", ((F.col("n") > 2) & (F.col("mean") < below)).alias("outlier"))


def members(clusters: DataFrame) -> DataFrame:
    """(cluster, members): the members in order."""
    return clusters.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("members"))


def best_scores(scored: DataFrame, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id_1", "id_2")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
