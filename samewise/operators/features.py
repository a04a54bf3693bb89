"""Wide features of candidate pairs: every family is one select over the joined sides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions import geo, similarity, text


def sides(pairs: DataFrame, entities: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Both sides' columns, as <name>_1 and <name>_2."""
    for i in (1, 2):
        pairs = pairs.join(entities.select(F.col(key).alias(f"id_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in columns]), f"id_{i}")
    return pairs


def ratio(x: Column, y: Column) -> Column:
    """x / max(1, y), to two places."""
    return F.round(x / F.greatest(F.lit(1), y), 2)


def string_features(name: str, kernels: bool = True) -> list[Column]:
    """Features of a text column of both sides, named <name>_<feature>."""
    a, b = F.coalesce(F.col(f"{name}_1"), F.lit("")), F.coalesce(F.col(f"{name}_2"), F.lit(""))
    n1, n2 = F.length(a), F.length(b)
    found = {
        "pi1": similarity.begins_inside(a, b),
        "pi": similarity.prefix_overlap(a, b),
        "pi2": similarity.suffix_overlap(a, b),
        "ld": F.levenshtein(a, b),
        "ll1": n1,
        "pi_r1": ratio(similarity.prefix_overlap(a, b), n1),
        "pi2_r1": ratio(similarity.suffix_overlap(a, b), n1),
        "r3": ratio(n1, n2),
        "na": similarity.missing(a, b),
        "m5": similarity.same_beginning(a, b, 5),
        "m10": similarity.same_beginning(a, b, 10),
        "levenshtein": similarity.edit_share(a, b),
        "len_diff": similarity.length_share(a, b),
        "included": similarity.included(a, b),
        "equal": similarity.equal(a, b),
    }
    if kernels:
        k = F.col(f"_{name}")
        found |= {
            "lcs": k["lcs"], "lcs2": k["lcs2"], "cclcs": k["blocks"], "lllcs": k["block_length"], "ljw": k["jaro_winkler"], "dsm1": k["ratio"],
            "lcs_r1": ratio(k["lcs"], n1), "lcs_r2": ratio(k["lcs"], n2), "lcs2_r1": ratio(k["lcs2"], n1), "lcs2_r2": ratio(k["lcs2"], n2),
            "lllcs_r1": ratio(k["block_length"], n1), "lllcs_r2": ratio(k["block_length"], n2), "lcs_r4": ratio(k["lcs2"], k["lcs"]),
        }
    return [c.alias(f"{name}_{f}") for f, c in found.items()]


def place_features() -> list[Column]:
    """Distance, its parts to the north and the east, and angles; needs latitude and longitude of both sides."""
    at = [F.col(f"{c}_{i}").cast("double") for i in (1, 2) for c in ("latitude", "longitude")]
    metres = F.floor(geo.coarse_metres(*at))
    north, east = geo.north_and_east(metres, at[0], at[2])
    return [geo.distance_step(d).alias(n) for n, d in (("dist", metres), ("dist1", north), ("dist2", east))] + [geo.least_angle(*at).alias("angular_distance_min"), geo.least_angle(*at, squared=True).alias("angular_distance_l2_min")]


def missing_features(columns: Sequence[str]) -> list[Column]:
    """any and both missing for each column, and how much each side tells."""
    gone = {(c, i): (F.coalesce(F.col(f"{c}_{i}").cast("string"), F.lit("")) == "").cast("int") for c in columns for i in (1, 2)}
    told = [sum((1 - gone[c, i] for c in columns), F.lit(0)) for i in (1, 2)]
    return [f for c in columns for f in (F.greatest(gone[c, 1], gone[c, 2]).alias(f"{c}_any_nan"), F.least(gone[c, 1], gone[c, 2]).alias(f"{c}_both_nan"))] + [told[0].alias("info_power_1"), told[1].alias("info_power_2"), F.abs(told[0] - told[1]).alias("info_diff")]


def combined_codes(language: str, category: str) -> list[Column]:
    """Language pair as smaller + 3 * larger; the category where both agree, else 0."""
    a, b = F.col(f"{language}_1"), F.col(f"{language}_2")
    return [(F.least(a, b) + 3 * F.greatest(a, b)).alias("langs"), F.when(F.col(f"{category}_1") == F.col(f"{category}_2"), F.col(f"{category}_1")).otherwise(0).alias("cat_simpl")]


def capped(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.least(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in caps.items() if c in df.columns})


def pair_features(pairs: DataFrame, entities: DataFrame, key: str, texts: Sequence[str], place: bool = False, kernels: bool = False) -> DataFrame:
    """(id_1, id_2, features): entities joined once, all built-in features in one select, kernels of each text in one Arrow call."""
    columns = [*texts, *(["latitude", "longitude"] if place else [])]
    joined = sides(pairs.select("id_1", "id_2"), entities, key, columns)
    if kernels:
        joined = joined.select("*", *[similarity.all_kernels(F.col(f"{t}_1"), F.col(f"{t}_2")).alias(f"_{t}") for t in texts])
    return joined.select("id_1", "id_2", *[f for t in texts for f in string_features(t, kernels)], *(place_features() if place else []), *missing_features(texts))


def number_features(name: str) -> list[Column]:
    a, b = (text.number_tokens(F.col(f"{name}_{i}")) for i in (1, 2))
    n, share = similarity.shared_elements(a, b)
    return [n.alias("nb_in_name"), F.round(share, 6).alias("ratio_in_name"), similarity.number_agreement(a, b).alias("num_in_name")]
