"""Nearest vectors by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 2048


def _unit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, embedding) as blocks (ids, vectors, width) of unit vectors; rows with nulls or of length 0 are left out."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            rows: dict[int, list] = {}
            for i, v in zip(part["id"].to_pylist(), part["embedding"].to_pylist(), strict=True):
                x = np.array(v if v else [], np.float64)
                length = np.sqrt(x @ x)
                if i is not None and length > 0 and np.isfinite(length):
                    rows.setdefault(len(x), []).append((i, x / length))
            for width, found in rows.items():
                ids, x = np.array([f[0] for f in found], "<i8"), np.stack([f[1] for f in found])
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([width], pa.int32())], names=["ids", "x", "width"])


def _best(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                (p, x), (q, y) = ((np.frombuffer(row[f"ids_{i}"], "<i8"), np.frombuffer(row[f"x_{i}"], "<f8").reshape(-1, row["width"])) for i in (1, 2))
                sim = np.where(p[:, None] == q[None, :], -np.inf, x @ y.T)
                least = -np.partition(-sim, min(k, sim.shape[1]) - 1, axis=1)[:, min(k, sim.shape[1]) - 1]
                i, j = np.nonzero((sim >= least[:, None] - 1e-5) & np.isfinite(sim))  # what rounding could bring up stays
                yield pa.RecordBatch.from_arrays([pa.array(p[i]), pa.array(q[j]), pa.array(sim[i, j])], names=["id_1", "id_2", "sim"])

    return work


def nearest_vectors(vectors: DataFrame, asked: str, k: int) -> DataFrame:
    """(id_1, id_2, sim, nth): for each vector (id, embedding) of the condition `asked` the k others of greatest cosine, to six places; ties by id.

    Blocks of asked vectors meet blocks of all vectors, dealt over a square of cells; a block passes the k best of each asked vector on, so what is shuffled is k rows for
    each asked vector and block.
    """
    blocks = "ids binary, x binary, width int"
    one = vectors.where(asked).mapInArrow(_unit_blocks, blocks).select(F.col("ids").alias("ids_1"), F.col("x").alias("x_1"), "width")
    two = vectors.mapInArrow(_unit_blocks, blocks).select(F.col("ids").alias("ids_2"), F.col("x").alias("x_2"), "width")
    # a square of cells: each block goes to one row or column of cells, so that no cell holds all blocks of either side
    side = max(1, math.isqrt(2 * vectors.sparkSession.sparkContext.defaultParallelism))
    own, every = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    one, two = one.withColumn("row", own("ids_1")).withColumn("column", every), two.withColumn("column", own("ids_2")).withColumn("row", every)
    met = one.join(two, ["row", "column", "width"]).drop("row", "column")
    best = met.mapInArrow(_best(k), "id_1 long, id_2 long, sim double").withColumn("sim", F.round("sim", 6))
    order = Window.partitionBy("id_1").orderBy(F.desc("sim"), "id_2")
    return best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
