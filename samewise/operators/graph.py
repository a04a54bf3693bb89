"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from samewise.session import drop_written, written

#: Edges that a task holds at once.
TASK_EDGES = 4 << 20


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges, in order, and the least id that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots hang below lesser ones
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def _stars(batches: Iterator[pa.RecordBatch], keyed: bool) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars (u, v, own): each id with the least one it reaches by them. Edges come in bounded lots, or, if keyed, together.

    own: all edges of u as first end were there, which is so for first ends of a keyed task.
    """
    held, n, kind = [], 0, None

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        ids, least = least_reached(u, v)
        own = np.zeros(len(ids), bool)
        if keyed:
            own[np.searchsorted(ids, u)] = True
        use = ids != least
        return pa.RecordBatch.from_arrays([pa.array(ids[use], kind), pa.array(least[use], kind), pa.array(own[use])], names=["u", "v", "own"])

    for b in batches:
        if b.num_rows:
            kind = b["u"].type
            held.append([b[c].to_numpy(zero_copy_only=False) for c in ("u", "v")])
            n += b.num_rows
            if n >= TASK_EDGES and not keyed:
                yield stars()
                held, n = [], 0
    if held:
        yield stars()


def components(edges: DataFrame, left: str = "a", right: str = "b", made: Callable | None = None) -> DataFrame:
    """(id, component) of each id that has an edge; component is the smallest id that it reaches.

    Tasks turn the edges they hold into stars, so whatever the number of edges of an id, a task passes at most one of them on as
    its first end. Each round lets ids point where their target points, deals the edges by their first end and makes stars again, until
    nothing moves: every id then points to an id that points nowhere, the least of its component. Each round is written to the
    shared folder. Edges of an id with itself or with null, and repeated edges, don't matter.

    With made, edges are rows that it, a function for mapInArrow, turns into batches of edges of longs between different ids: it runs in the same
    Python workers as the stars, where a mapInArrow of its own would have each task hold a second one.
    """
    if made is None:
        both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
        ends = both.schema.fields
    else:
        both, ends = edges, [StructField("u", LongType()), StructField("v", LongType())]
    schema = StructType([*ends, StructField("own", BooleanType())])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if made is not None:
            batches = (pa.RecordBatch.from_arrays([b[left], b[right]], names=["u", "v"]) for b in made(batches))
        return _stars(batches, False)

    now = written(both.mapInArrow(begun, schema), "edges")
    state, seen = _state(now), None
    while state != seen:
        first = now.select("u", "v")
        onward = now.where("own").select(F.col("u").alias("v"), F.col("v").alias("to"))  # one row for an id
        moved = first.join(onward, "v", "left").select("u", F.coalesce("to", "v").alias("v")).where("u <> v")
        parts = -(-state[0] // TASK_EDGES)
        dealt = moved.repartition(parts, "u") if parts > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else moved.repartition("u")
        then = written(dealt.mapInArrow(lambda batches: _stars(batches, True), schema), "edges")
        seen, state = state, _state(then)
        drop_written(now)
        now = then
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v", "own").cast("decimal(38,0)"))).first())
