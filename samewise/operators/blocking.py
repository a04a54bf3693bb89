"""Candidate pairs. Each blocker gives (id_1, id_2, source); canonical() makes id_1 < id_2 and pairs distinct.

Blockers join on equal keys or look at the next rows of a sorted partition; none makes all pairs of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.session import written


def canonical(pairs: DataFrame) -> DataFrame:
    """id_1 < id_2, without self pairs and repeats."""
    ordered = pairs.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2"))
    return ordered.where("id_1 <> id_2").distinct()


def not_in(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that are not known yet."""
    return pairs.join(known.select("id_1", "id_2"), ["id_1", "id_2"], "left_anti")


#: Rows of a window in sorted_neighbours, at least.
WINDOW_ROWS = 8192


def sorted_neighbours(df: DataFrame, key: str, partition: Sequence[str], order: Sequence[str], k: int, values: Sequence[str] = ()) -> DataFrame:
    """Each row with the next k of its partition in order: id_1, id_2, step, and both sides' values as <name>_1, <name>_2.

    Nulls come first and are equal as partitions. The whole table has one order, by partition and then by order, and is read in
    windows of so many consecutive places, each with the first k rows of the next: a partition of any size is dealt over all tasks.
    """
    rows = df.select(F.col(key).alias("id_1"), F.struct(F.col(key).alias("id"), *values).alias("_own"), F.struct(*partition).alias("_group"), F.struct(*order).alias("_order"))
    size = max(WINDOW_ROWS, 8 * k)
    placed = ranked(rows, ["_group", "_order"], "_at").drop("_order").withColumn("_window", F.floor(F.col("_at") / size))
    after = placed.where(F.col("_at") % size < k).withColumn("_window", F.col("_window") - 1)
    window = Window.partitionBy("_window").orderBy("_at")
    entry = F.struct("_own", "_group")
    ahead = F.array(*[F.struct(F.lit(j).alias("step"), F.lead(entry, j).over(window).alias("row")) for j in range(1, k + 1)])
    found = placed.unionByName(after).withColumn("_ahead", ahead).where(F.col("_window") == F.floor(F.col("_at") / size))
    found = found.select("id_1", "_own", "_group", F.explode("_ahead").alias("next")).where(F.col("next.row").isNotNull() & F.col("next.row._group").eqNullSafe(F.col("_group")))
    return found.select("id_1", F.col("next.row._own.id").alias("id_2"), F.col("next.step").alias("step"), *[c for v in values for c in (F.col(f"_own.{v}").alias(f"{v}_1"), F.col(f"next.row._own.{v}").alias(f"{v}_2"))])


def shifted_grid(df: DataFrame, key: str, lat: Column, lon: Column, width: float, partition: Sequence[str], k: int) -> DataFrame:
    """Pairs within k rows in one cell of any of four grids, shifted by half a cell. (Cells at the table's rim are as wide in degrees as others.)"""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0.0, 0.5) for b in (0.0, 0.5)])).alias("s")
    cells = df.select(key, *partition, lat.alias("_lat"), lon.alias("_lon"), shifts)
    cells = cells.select(key, *partition, F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.floor(F.col("_lat") / width + F.col("s.a")).alias("cell_lat"), F.floor(F.col("_lon") / width + F.col("s.b")).alias("cell_lon"))
    return canonical(sorted_neighbours(cells, key, ["a", "b", *partition, "cell_lat", "cell_lon"], [key], k))


def cell_pairs(df: DataFrame, key: str, cell: Sequence[str], most: int, values: Sequence[str] = ()) -> DataFrame:
    """All pairs of cells of at most `most` rows. Larger cells are read in order of the key: each row with the next `most`."""
    size = df.groupBy(*cell).agg(F.count("*").alias("cell_rows"))
    sized = df.join(size, list(cell))
    small = sized.where(F.col("cell_rows") <= most).select(key, *cell, *values)
    left = small.select(*cell, F.col(key).alias("id_1"), *[F.col(v).alias(f"{v}_1") for v in values])
    right = small.select(*cell, F.col(key).alias("id_2"), *[F.col(v).alias(f"{v}_2") for v in values])
    within = left.join(right, list(cell)).where("id_1 < id_2").drop(*cell)
    # larger cells: places in one order of the whole table, joined by blocks of places, so that no task holds a cell
    place = ranked(sized.where(F.col("cell_rows") > most).select(key, *cell, *values), [*cell, key], "cell_place").withColumn("_block", F.floor(F.col("cell_place") / most))
    first = place.select(*cell, F.col(key).alias("id_1"), *[F.col(v).alias(f"{v}_1") for v in values], F.col("cell_place").alias("_p1"), F.explode(F.array(F.col("_block"), F.col("_block") + 1)).alias("_block"))
    second = place.select(*cell, F.col(key).alias("id_2"), *[F.col(v).alias(f"{v}_2") for v in values], F.col("cell_place").alias("_p2"), "_block")
    large = first.join(second, [*cell, "_block"]).where((F.col("_p2") > F.col("_p1")) & (F.col("_p2") <= F.col("_p1") + most))
    return within.unionByName(large.select(within.columns))


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds each row's place in the order of the whole table, from 0, without a single partition.

    Rows are range-partitioned, sorted, numbered within their partition and written once: range bounds are sampled anew each time a
    plan is run, so sizes and places must come from one and the same run. Places are then shifted by the sizes of the
    partitions before. Equal rows have places in any order.
    """
    spread = (df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    first = F.shiftleft(F.spark_partition_id().cast("long"), 33)  # as monotonically_increasing_id counts
    spread = written(spread.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id() - first}), "ranked")
    before = running_before(spread.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    return spread.join(F.broadcast(before), "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def running_before(sizes: DataFrame, column: str) -> DataFrame:
    """(_part, _before) of sizes (_part, column): what all parts before hold. It has a row for each partition of a range shuffle."""
    a, b = sizes.select("_part"), sizes.select(F.col("_part").alias("_other"), F.col(column).alias("_size"))
    return a.join(F.broadcast(b), F.col("_other") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_before"))


def circular_shifts(rows: DataFrame, key: str, rank: str, total: int, shifts: Sequence[int]) -> DataFrame:
    """Each row with those `shifts` places behind it, around the end: id_1, id_2, shift."""
    ahead = rows.select(F.col(key).alias("id_1"), F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"), F.col(rank).alias("_r")).withColumn("_r", (F.col("_r") + F.col("shift")) % total)
    return ahead.join(rows.select(F.col(key).alias("id_2"), F.col(rank).alias("_r")), "_r").drop("_r")


def name_rule(a: Column, b: Column, substring: float, subsequence: float, last: int) -> Column:
    """One name's first four characters in the other, a common substring or subsequence of so much of the mean length, or equal last characters."""
    from samewise.functions import similarity

    mean = (F.length(a) + F.length(b)) / 2
    longest = [similarity.kernel("int", f)(a, b) for f in (similarity.longest_substring, similarity.longest_subsequence)]
    ends = (F.length(a) >= last) & (F.length(b) >= last) & (F.right(a, F.lit(last)) == F.right(b, F.lit(last)))
    return (similarity.begins_inside(a, b) == 1) | ((mean > 0) & ((longest[0] >= substring * mean) | (longest[1] >= subsequence * mean))) | ends


def shifted_pairs(df: DataFrame) -> DataFrame:
    """(id_1, id_2, shift, source) of the circular shifts W10-W13 over the whole table, with their rules of distance and name.

    df: id, name, category, country, latitude, longitude, and the category's usual distances q90 and q99. The first of a pair gives q90 and q99.
    """
    from samewise.functions import geo

    values = ["name", "category", "latitude", "longitude"]
    df = df.withColumns({"name": F.coalesce("name", F.lit("")), "lat0": F.bround("latitude"), "lon0": F.bround("longitude"), "lat2": F.bround("latitude", 2), "lon2": F.bround("longitude", 2)})
    near = ["lat0", "lon0", "name", "latitude", "category", "country", "id"]
    total = df.count()
    found = []
    for source, order, shifts in (("W11", near, range(1, 15)), ("W12", ["country", "lat2", "lon2", "category", "id"], range(1, 107)), ("W13", list(dict.fromkeys(["category", *near])), range(1, 50))):
        pairs = circular_shifts(ranked(df.select("id", *[c for c in order if c != "id"]), order), "id", "rank", total, list(shifts))
        for i, more in ((1, ["q90", "q99"]), (2, [])):
            pairs = pairs.join(df.select(F.col("id").alias(f"id_{i}"), *[F.col(v).alias(f"{v}_{i}") for v in values], *more), f"id_{i}")
        metres = geo.coarse_metres(*[F.col(f"{c}_{i}").cast("double") for i in (1, 2) for c in ("latitude", "longitude")])
        pairs, shift, same = pairs.withColumn("metres", metres), F.col("shift"), F.coalesce(F.col("category_1") == F.col("category_2"), F.lit(False))
        if source == "W13":
            good = same & (F.col("metres") < 400 * (F.col("q90") + F.col("q99"))) & name_rule(F.col("name_1"), F.col("name_2"), 0.6, 0.7, 6)
        else:
            # place after place: shift 14 + n of the reference is n places on in the second order
            most = F.when(shift < 4, 500000).when(shift < 8, 10000).when(shift < 12, 5000).otherwise(2000) if source == "W11" else F.greatest(F.lit(100), 200 - (shift + 14 - 16))
            good = (F.col("metres") < most) | name_rule(F.col("name_1"), F.col("name_2"), 0.65, 0.75, 7) | (same & (F.col("metres") < 900 * F.col("q90")))
            good = good | (shift == 1) if source == "W11" else good
        named = F.when((F.lit(source) == "W11") & (shift == 1), "W10").otherwise(source)
        found.append(pairs.where(good).select("id_1", "id_2", "shift", named.alias("source")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def bucket_pairs(df: DataFrame, key: str, buckets: dict[str, int]) -> DataFrame:
    """Pairs that share a value of a column of at most so many rows. (The limit is the blocker's meaning: a value of many rows tells little.)"""
    found = []
    for column, most in buckets.items():
        rows = df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").select(key, column)
        rare = rows.groupBy(column).agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select(column)
        kept = rows.join(rare, column)
        found.append(kept.select(column, F.col(key).alias("id_1")).join(kept.select(column, F.col(key).alias("id_2")), column).where("id_1 < id_2").select("id_1", "id_2"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def cells_around(df: DataFrame, lat: str, lon: str, width: float, reach: int = 1) -> DataFrame:
    """Rows once for each cell around their own: cell_lat, cell_lon."""
    near = [F.lit(d) for d in range(-reach, reach + 1)]
    out = df.withColumn("_dlat", F.explode(F.array(*near))).withColumn("_dlon", F.explode(F.array(*near)))
    return out.withColumn("cell_lat", F.floor(F.col(lat) / width) + F.col("_dlat")).withColumn("cell_lon", F.floor(F.col(lon) / width) + F.col("_dlon")).drop("_dlat", "_dlon")


def in_cell(df: DataFrame, lat: str, lon: str, width: float) -> DataFrame:
    return df.withColumn("cell_lat", F.floor(F.col(lat) / width)).withColumn("cell_lon", F.floor(F.col(lon) / width))


def nearest_places(df: DataFrame, key: str, lat: str, lon: str, partition: Sequence[str], k: int, radius: float) -> DataFrame:
    """(id_1, id_2, distance) of the k nearest other rows of the partition within the radius, in degrees; ties by id."""
    left = cells_around(df.select(F.col(key).alias("id_1"), F.col(lat).alias("lat_1"), F.col(lon).alias("lon_1"), *partition), "lat_1", "lon_1", radius)
    right = in_cell(df.select(F.col(key).alias("id_2"), F.col(lat).alias("lat_2"), F.col(lon).alias("lon_2"), *partition), "lat_2", "lon_2", radius)
    met = left.join(right, [*partition, "cell_lat", "cell_lon"]).where("id_1 <> id_2")
    met = met.withColumn("distance", F.sqrt(F.pow(F.col("lat_1") - F.col("lat_2"), 2) + F.pow(F.col("lon_1") - F.col("lon_2"), 2))).where(F.col("distance") <= radius)
    order = Window.partitionBy("id_1").orderBy("distance", "id_2")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("id_1", "id_2", "distance", "nth")


def radius_counts(points: DataFrame, key: str, places: DataFrame, lat: str, lon: str, radii: Sequence[float]) -> DataFrame:
    """For each point, places within each radius (degrees): n_<i>. Points and places have columns lat and lon."""
    width = max(radii)
    around = cells_around(points.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")), "_lat", "_lon", width)
    here = in_cell(places.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon")), "p_lat", "p_lon", width)
    squared = F.pow(F.col("_lat") - F.col("p_lat"), 2) + F.pow(F.col("_lon") - F.col("p_lon"), 2)
    counted = around.join(here, ["cell_lat", "cell_lon"]).groupBy(key).agg(*[F.count_if(squared <= r * r).alias(f"n_{i}") for i, r in enumerate(radii)])
    return points.select(key).join(counted, key, "left").select(key, *[F.coalesce(f"n_{i}", F.lit(0)).alias(f"n_{i}") for i in range(len(radii))])
