"""Pairs of near places with alike names, by blocks of places of one grid cell: blocks meet in tasks, no pair is shuffled.

Names are alike if one's first characters are inside the other, or if a common substring has a quarter of both lengths together (half their mean).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators import blocking
from samewise.session import written

#: Places of a block, at most; meetings of two blocks in a task, about; pairs given at once.
BLOCK, MEETINGS, GIVEN = 1024, 16, 1 << 16
#: A cell and the half of the cells around it that it meets; the others meet it.
AROUND = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


class _Side:
    def __init__(self, places: pa.StructArray):
        self.id, self.lat, self.lon = (places.field(c).to_numpy(zero_copy_only=False) for c in ("id", "lat", "lon"))
        self.names = places.field("name").to_pylist()
        self.length = np.array([len(x) for x in self.names])


def within(a: _Side, b: _Side, degrees: float) -> np.ndarray:
    """Which places of a and b are within so many degrees; not a place and itself."""
    with np.errstate(all="ignore"):
        return (np.sqrt((a.lat[:, None] - b.lat) ** 2 + (a.lon[:, None] - b.lon) ** 2) <= degrees) & (a.id[:, None] != b.id)


def begin_inside(a: Sequence[str], b: Sequence[str], n: int = 4) -> np.ndarray:
    """[i, j]: whether the first n characters of b[j] are inside a[i]; not for shorter names."""
    first = [y[:n] if len(y) >= n else None for y in b]
    number = {g: k for k, g in enumerate(dict.fromkeys(g for g in first if g is not None))}
    held = np.zeros((len(a), len(number) + 1), bool)
    for i, x in enumerate(a):
        held[i, [number[g] for g in {x[s : s + n] for s in range(len(x) - n + 1)} if g in number]] = True
    return held[:, [number.get(g, len(number)) for g in first]]


def share_half(a: _Side, b: _Side, asked: np.ndarray) -> np.ndarray:
    """Which of the asked pairs of names have a common substring of half their mean length.

    For one of n characters and w <= (n + 1) / 2 it covers one of the consecutive parts of w characters of the first name, so the second
    must hold one; w is a power of two, so that all pairs of names take few widths. Pairs left are looked at character by character.
    """
    total = a.length[:, None] + b.length
    need = (total + 3) // 4
    asked = asked & (total > 0) & (need <= a.length[:, None]) & (need <= b.length)
    out, power = np.zeros_like(asked), np.frexp((need + 1) // 2)[1] - 1
    for p in np.unique(power[asked]).tolist():
        here, w = asked & (power == p), 1 << p
        parts: dict[str, list[int]] = {}
        for i in np.flatnonzero(here.any(1)).tolist():
            for g in {a.names[i][s : s + w] for s in range(0, len(a.names[i]) - w + 1, w)}:
                parts.setdefault(g, []).append(i)
        met = np.zeros_like(asked)
        for j in np.flatnonzero(here.any(0)).tolist():
            for g in {b.names[j][s : s + w] for s in range(len(b.names[j]) - w + 1)}:
                if g in parts:
                    met[parts[g], j] = True
        for i, j in zip(*(at.tolist() for at in np.nonzero(met & here)), strict=True):
            x, y, n = a.names[i], b.names[j], int(need[i, j])
            out[i, j] = x == y or any(x[s : s + n] in y for s in range(len(x) - n + 1))
    return out


def _alike(degrees: float):
    """Over meetings of two blocks: their pairs, the lesser id first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (_Side(batch[f"places_{k}"][i].values) for k in (1, 2))
                met = within(a, b, degrees)
                if batch["block_1"][i] == batch["block_2"][i]:
                    met = np.triu(met)
                if not met.any():
                    continue
                begin = begin_inside(a.names, b.names) | begin_inside(b.names, a.names).T
                p, q = np.nonzero((met & begin) | share_half(a, b, met & ~begin))
                x, y = a.id[p], b.id[q]
                for s in range(0, len(x), GIVEN):
                    ends = x[s : s + GIVEN], y[s : s + GIVEN]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["id_1", "id_2"])

    return work


def alike_within(rows: DataFrame, degrees: float, group: str = "country") -> DataFrame:
    """(id_1, id_2), id_1 < id_2, of all places (id, name, latitude, longitude) of a group within so many degrees with alike names.

    Cells are a little wider than the distance, so rounding puts no two near places two cells apart. A cell of any size is dealt over blocks, and
    meetings of blocks over tasks. The id is a long.
    """
    width = degrees * 1.001
    cell = [F.floor(F.col(c) / width).alias(f"cell_{c}") for c in ("latitude", "longitude")]
    place = [F.col("id").cast("long").alias("id"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"), "name"]
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ("id", "name", "latitude", "longitude", group)))
    ranked = blocking.ranked(whole.select(F.col(group).alias("group"), *cell, *place), ["group", "cell_latitude", "cell_longitude", "id"], "_at")
    at = ["group", "cell_latitude", "cell_longitude"]
    made = ranked.groupBy(*at, F.floor(F.col("_at") / BLOCK).alias("_nth")).agg(F.collect_list(F.struct("id", "lat", "lon", "name")).alias("places"))
    blocks = written(made.drop("_nth").withColumn("block", F.monotonically_increasing_id()), "places")
    around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in AROUND]))
    ones = blocks.select(F.col("block").alias("block_1"), *at, around.alias("_to"))
    ones = ones.select("block_1", "group", (F.col("cell_latitude") + F.col("_to.y")).alias("cell_latitude"), (F.col("cell_longitude") + F.col("_to.x")).alias("cell_longitude"), (F.col("_to") == F.struct(F.lit(0).alias("y"), F.lit(0).alias("x"))).alias("_own"))
    meet = written(ones.join(blocks.select(F.col("block").alias("block_2"), *at), at).where("NOT _own OR block_1 <= block_2").select("block_1", "block_2"), "meetings")
    tasks = max(1, -(-meet.count() // MEETINGS))
    for i in (1, 2):
        side = blocks.select(F.col("block").alias(f"block_{i}"), F.col("places").alias(f"places_{i}"))
        meet = meet.repartition(tasks, f"block_{i}").join(side.repartition(tasks, f"block_{i}"), f"block_{i}")
    return meet.mapInArrow(_alike(degrees), "id_1 long, id_2 long")
