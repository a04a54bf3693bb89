"""Blockers for one kind of place: candidates by name or bucket, kept by rules of category, distance and name.

entities: id, name, category (a small number; -1 unknown, 0 none), country, latitude, longitude. All give (id_1, id_2), id_1 < id_2.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions import geo, similarity, text
from samewise.operators import blocking, near, tfidf
from samewise.operators.features import sides

# Fixed values that results depend on.
AIRPORT, AIRFIELD, UNKNOWN, METRO = 1, 2, -1, 4
SAME_NAME = 0.45
#: Least similarity, most km, and most km without a common category, by country number.
COUNTRY_TIERS = {2: (1.1, 20.0, -1.0), 3: (0.6, 10.0, 2.0), 32: (0.4, 100.0, 100.0)}


def km(i: int = 1, j: int = 2) -> Column:
    return geo.haversine_km(*[F.col(f"{c}_{k}").cast("double") for k in (i, j) for c in ("latitude", "longitude")])


def like_names(entities: DataFrame, name: Column, threshold: float = SAME_NAME, least: int = 1, values: Sequence[str] = ()) -> DataFrame:
    """(id_1, id_2, sim) of names of so many characters whose word vectors are alike, and both sides' values as <name>_1, <name>_2.

    (A rule "at the threshold, or the best of a row" keeps the same pairs, as each row's best is itself, at 1.)
    """
    named = entities.select("id", name.alias("_name"), *values).where(F.length("_name") >= least)
    return tfidf.alike(named, "id", tfidf.words(F.col("_name")), threshold, values)


def _with_sides(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    return sides(pairs, entities, "id", ["name", "category", "country", "latitude", "longitude"])


def _same_category() -> Column:
    return (F.col("category_1") == F.col("category_2")) & (F.col("category_1") > 0)


def airports(entities: DataFrame, everywhere: str = "kualalumpur") -> DataFrame:
    """Alike names of airports, airfields and unknown places, one of them an airport, within 100 km (or any distance for one city)."""
    rows = entities.where(F.col("category").isin(AIRPORT, AIRFIELD, UNKNOWN))
    pairs = like_names(rows, text.terminal_name(F.col("name")), least=2, values=["name", "category", "latitude", "longitude"])
    airport = (F.col("category_1") == AIRPORT) | (F.col("category_2") == AIRPORT)
    return pairs.where(airport & ((km() <= 100) | F.contains("name_1", F.lit(everywhere)))).select("id_1", "id_2")


def stations(entities: DataFrame, names: Sequence[str] = ("name",)) -> DataFrame:
    """Alike names of metro stations, in any of some spellings, within 100 km."""
    rows = entities.where(F.col("category") == METRO)
    found = [like_names(rows, text.station_name(F.col(n)), least=3).select("id_1", "id_2") for n in names]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return _with_sides(pairs.distinct(), rows).where(km() <= 100).select("id_1", "id_2")


def in_country(entities: DataFrame, tiers: Mapping[int, tuple[float, float, float]] = COUNTRY_TIERS, name: str = "name") -> DataFrame:
    """Alike names within a country, by its tier: (least similarity unless the category is the same, most km, most km unless so)."""
    found = []
    for country, (least, far, far_other) in tiers.items():
        rows = entities.where(F.col("country") == country)
        pairs = like_names(rows, F.col(name), min(SAME_NAME, least), values=["category", "latitude", "longitude"]).withColumn("km", km())
        same = _same_category()
        found.append(pairs.where((F.col("km") <= far) & (same | (F.col("km") <= far_other)) & (same | (F.round("sim", 5) >= least))).select("id_1", "id_2"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def shared_buckets(entities: DataFrame, buckets: Mapping[str, int], rare: int = 5) -> DataFrame:
    """Pairs of a bucket (column: most rows) within a distance that their names and categories set.

    26 km; 100 for equal names of at most `rare` rows; 350 if one is an airfield, any if one is an airport; 15 more for equal names of
    ten characters or more.
    """
    counts = entities.groupBy("name").agg(F.count("*").alias("same_name"))
    columns = ["name", "category", "latitude", "longitude"]
    pairs = sides(blocking.bucket_pairs(entities, "id", dict(buckets)), entities, "id", columns).join(counts.withColumnRenamed("name", "name_1"), "name_1")
    either = lambda c: (F.col("category_1") == c) | (F.col("category_2") == c)
    same = F.col("name_1") == F.col("name_2")
    base = F.when(either(AIRPORT), 100_000).when(either(AIRFIELD), 350).when(same & (F.col("same_name") <= rare), 100).otherwise(26)
    return pairs.where(km() <= base + F.when(same & (F.length("name_1") >= 10), 15).otherwise(0)).select("id_1", "id_2")


def near_with_like_name(entities: DataFrame, countries: Sequence[int] = (2, 3), k: int | None = 400, degrees: float = 0.12) -> DataFrame:
    """The k nearest places of the country within so many degrees (the place itself counts as one) whose names begin inside one another or share half their mean length.

    All places within the distance if k is None: then no pair is shuffled.
    """
    rows = entities.where(F.col("country").isin(*countries))
    if k is None:
        return near.alike_within(rows, degrees)
    nearest = blocking.nearest_places(rows, "id", "latitude", "longitude", ["country"], k - 1, degrees).select("id_1", "id_2")
    pairs = sides(blocking.canonical(nearest), rows, "id", ["name"])
    a, b = F.col("name_1"), F.col("name_2")
    begins = similarity.begins_inside(a, b) == 1
    # the kernel takes about a millisecond for two long names, so it sees only pairs that can reach the share and don't stay anyway
    pairs = pairs.where(begins | similarity.may_share(a, b, F.ceil((F.length(a) + F.length(b)) / 4)))
    longest = similarity.kernel("int", similarity.longest_substring)(*[F.when(begins | (a == b), "").otherwise(c) for c in (a, b)])
    pairs = pairs.withColumn("longest", F.when(a == b, F.length(a)).otherwise(longest))
    return pairs.where(begins | (similarity.mean_length_ratio(F.col("longest"), a, b) >= 0.5)).select("id_1", "id_2")


#: Metres of the radii, and metres of a degree in this test. Fixed values.
RADII = (2000, 1000, 500, 200, 100, 50, 5000)
DEGREE = 111_111


def midpoint_counts(pairs: DataFrame, entities: DataFrame, category: str | None = None, radii: Sequence[int] = RADII, margin: float = 0.1) -> DataFrame:
    """(id_1, id_2, near_<metres>...) of pairs: places around the midpoint, of one of the pair's categories if a category column is named.

    Degrees of longitude are scaled by the cosine of the latitude's number, as if it were in radians (as the features were defined). Places count
    within the midpoint's whole degree of longitude and `margin` beyond it. Pairs meet places in strips of latitude of the widest radius.
    """
    columns = ["latitude", "longitude", *([category] if category else [])]
    ends = sides(pairs.select("id_1", "id_2"), entities, "id", columns)
    mid = {c: ((F.col(f"{c}_1") + F.col(f"{c}_2")) / 2).alias(f"mid_{c}") for c in ("latitude", "longitude")}
    kinds = [F.col(f"{category}_{i}").alias(f"_kind_{i}") for i in (1, 2)] if category else []
    width = max(radii) / DEGREE
    here = ends.select("id_1", "id_2", *mid.values(), *kinds).withColumn("_strip", F.floor("mid_longitude"))
    here = here.withColumn("_row", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col("mid_latitude") / width) + i)))
    places = entities.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), *([F.col(category).alias("_kind")] if category else [])).withColumn("_row", F.floor(F.col("_lat") / width))
    strips = F.array_distinct(F.array(F.floor("_lon"), F.floor(F.col("_lon") + margin), F.floor(F.col("_lon") - margin)))
    met = here.join(places.withColumn("_strip", F.explode(strips)), ["_row", "_strip"])
    met = met.where((F.col("_lon") > F.col("_strip") - margin) & (F.col("_lon") < F.col("_strip") + 1 + margin))
    if category:
        met = met.where((F.col("_kind") == F.col("_kind_1")) | (F.col("_kind") == F.col("_kind_2")))
    squared = F.pow(F.col("_lat") - F.col("mid_latitude"), 2) + F.pow(F.cos("mid_latitude"), 2) * F.pow(F.col("_lon") - F.col("mid_longitude"), 2)
    counted = met.withColumn("_d", squared).groupBy("id_1", "id_2").agg(*[F.count_if(F.col("_d") < r * r / DEGREE**2).alias(f"near_{r}") for r in radii])
    out = pairs.select("id_1", "id_2").join(counted, ["id_1", "id_2"], "left")
    return out.select("id_1", "id_2", *[F.coalesce(f"near_{r}", F.lit(0)).cast("long").alias(f"near_{r}") for r in radii])


def widest_of_categories(rows: DataFrame, key: str, categories: str, table: DataFrame, names: Sequence[str], default: Sequence[float]) -> DataFrame:
    """For each row the greatest of each number that table (category, names) has for any of its categories; the default if for none."""
    each = rows.select(key, F.explode_outer(categories).alias("category")).join(table, "category", "left")
    found = each.groupBy(key).agg(*[F.max(n).alias(n) for n in names], F.count(names[0]).alias("_known"))
    return found.select(key, *[F.when(F.col("_known") > 0, F.col(n)).otherwise(F.lit(d)).alias(n) for n, d in zip(names, default, strict=True)])
