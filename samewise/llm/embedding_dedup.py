"""Near duplicates of vectors by an epsilon grid order join.

Unit vectors of cosine >= c lie within eps = sqrt(2 - 2c) of each other. Vectors are turned to their principal axes
(a rotation keeps distances) and sorted by the grid cells, of side eps, of the leading axes. Consecutive vectors form
blocks; two blocks meet only if their cells and boxes come within eps. Within a task two blocks are joined recursively:
each is halved while its bounding box is far enough from the other's to be skipped or large enough to be halved, and what
is left is compared on the leading axes first (with the length of the rest, which bounds the cosine), then by cosine in
double precision. No pair of vectors within eps is skipped.

Equal vectors are one row with a count. Counts of links are sums over block pairs; classes come from spanning links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.words import record_batch
from samewise.operators.graph import components
from samewise.session import written

COSINE = 0.9
GRID_AXES = 4
BLOCK = 4096
LEAF = 1024
#: Leading axes that are looked at before all of them.
HEAD = 16
SUM_TASKS = 16
#: Rounding of boxes and cells may not exclude a pair: distances are compared with this much more.
SLACK = 1e-6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sound vectors as packed doubles, over a power of two (so that no square overflows or vanishes; cosines stay); others as null."""
    for b in batches:
        column = b["embedding"].cast(pa.list_(pa.float64()))
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
        valid = column.is_valid().to_pylist()
        out: list[bytes | None] = []
        for i, ok in enumerate(valid):
            v = flat[offsets[i] : offsets[i + 1]]
            ok = ok and len(v) and np.isfinite(v).all() and v.any()
            out.append((np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) + 0.0).astype("<f8").tobytes() if ok else None)
        yield record_batch(["vec_id", "v"], [b["vec_id"].cast(pa.int64()), pa.array(out, pa.binary())])


def _cells(axes: np.ndarray, eps: float, grid: int):
    """Adds the grid cell on the leading axes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b["v"])
                cell = np.floor((x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[:, :grid] / eps).astype(np.int64)
                yield record_batch(["id", "n", "v", "cell"], [b["id"], b["n"], b["v"], pa.array(cell.tolist(), pa.list_(pa.int64()))])

    return work


_SUMS = "n long, s array<double>, c array<double>"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, sum and sum of products of unit vectors: one row for a task."""
    total = None
    for b in batches:
        if b.num_rows:
            x = _matrix(b["v"])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            part = [len(x), x.sum(0), (x.T @ x).ravel()]
            total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
    yield from _sums(total)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums as one row, read one after another."""
    total = None
    for b in batches:
        for i in range(b.num_rows):
            part = [b["n"][i].as_py(), *(b[c][i].values.to_numpy() for c in ("s", "c"))]
            total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
    yield from _sums(total)


def _sums(total: list | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield record_batch(["n", "s", "c"], [pa.array([total[0]], pa.int64()), *(pa.ListArray.from_arrays([0, len(x)], pa.array(x, pa.float64())) for x in total[1:])])


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes (columns), most spread first, of all unit vectors.

    Tasks add up their vectors side by side, SUM_TASKS tasks add up what they give, and these SUM_TASKS width x width matrices come
    to the driver one after another.
    """
    n, s, c = 0, np.zeros(width), np.zeros((width, width))
    sums = vectors.select("v").mapInArrow(_moments, _SUMS).repartition(SUM_TASKS).mapInArrow(_added, _SUMS)
    for r in sums.toLocalIterator():
        n, s, c = n + r["n"], s + np.array(r["s"]), c + np.array(r["c"]).reshape(width, width)
    if not n:
        return np.eye(width)
    _, axes = np.linalg.eigh(c / n - np.outer(s / n, s / n))
    return axes[:, ::-1].copy()


class Part:
    """Consecutive vectors of a block: values (as given), lengths, places on the principal axes, counts, and the box around them.

    head is each unit vector's place on the first HEAD axes and the length of what is left of it: the product of two heads
    is no less than the cosine.
    """

    def __init__(self, x, length, y, ids, n):
        self.x, self.length, self.y, self.ids, self.n = x, length, y, ids, n
        self.low, self.high = y.min(0), y.max(0)

    def take(self, i) -> Part:
        return Part(self.x[i], self.length[i], self.y[i], self.ids[i], self.n[i])

    def head(self) -> np.ndarray:
        rest = np.sqrt((self.y[:, HEAD:].astype(np.float64) ** 2).sum(1))
        return np.column_stack([self.y[:, :HEAD], rest]).astype(np.float32)

    def halves(self) -> tuple[Part, Part]:
        """Split where the box is longest."""
        axis = int((self.high - self.low).argmax())
        order = np.argpartition(self.y[:, axis], len(self.ids) // 2)
        cut = len(order) // 2
        return self.take(order[:cut]), self.take(order[cut:])


def compare(a: Part, b: Part, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with that cosine, in double precision; heads rule most others out."""
    near = a.head() @ b.head().T >= cosine - SLACK * 100
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    if len(i) > near.size // 20:
        found = (a.x @ b.x.T) / (a.length[:, None] * b.length[None, :]) >= cosine
        return np.nonzero(np.triu(found, 1) if same else found)
    keep = [np.einsum("ij,ij->i", a.x[i[k : k + 65536]], b.x[j[k : k + 65536]]) / (a.length[i[k : k + 65536]] * b.length[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)]
    good = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[good], j[good]


def join_parts(a: Part, b: Part, eps: float, cosine: float, same: bool, out: list) -> None:
    """Adds (ids of a, ids of b, counts of a, counts of b) of all pairs with that cosine."""
    gap = np.maximum(0, np.maximum(a.low - b.high, b.low - a.high))
    if (gap**2).sum() > eps * eps:
        return
    if len(a.ids) <= LEAF and len(b.ids) <= LEAF:
        i, j = compare(a, b, cosine, same)
        if len(i):
            out.append((a.ids[i], b.ids[j], a.n[i], b.n[j]))
        return
    if same:
        p, q = a.halves()
        join_parts(p, p, eps, cosine, True, out)
        join_parts(q, q, eps, cosine, True, out)
        join_parts(p, q, eps, cosine, False, out)
    elif len(a.ids) >= len(b.ids):
        for p in a.halves():
            join_parts(p, b, eps, cosine, False, out)
    else:
        for q in b.halves():
            join_parts(a, q, eps, cosine, False, out)


def _narrow(x: np.ndarray) -> bytes:
    """Packed values, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return single.tobytes() if (single == x).all() else x.astype("<f8").tobytes()


def _block_rows(axes: np.ndarray, eps: float, grid: int, size: int):
    """Rows in grid order become blocks: id, corners of the box on the grid axes, and the vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held = TaskContext.get().partitionId(), 0, []

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal k
            x = _matrix(t["v"])
            y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[:, :grid]
            k += 1
            low, high = y.min(0), y.max(0)
            return record_batch(["block", "low", "high", "ids", "n", "x"], [
                pa.array([(task << 32) + k], pa.int64()), pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64())),
                pa.array([t["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([t["n"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([_narrow(x)], pa.binary()),
            ])

        rows = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            while rows >= size:
                t = pa.concat_tables(held)
                yield block(t.slice(0, size))
                held, rows = [t.slice(size)], rows - size
        if rows:
            yield block(pa.concat_tables(held))

    return work


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie the same ids together, at most one for each id."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _join_blocks(axes: np.ndarray, eps: float, cosine: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(b, i, side) -> Part:
            ids = np.frombuffer(b[f"ids{side}"][i].as_buffer(), "<i8")
            raw = b[f"x{side}"][i].as_buffer()
            x = np.frombuffer(raw, "<f4" if raw.size == 4 * len(ids) * axes.shape[0] else "<f8").astype(np.float64).reshape(len(ids), -1)
            length = np.sqrt((x * x).sum(1))
            return Part(x, length, (x / length[:, None]) @ axes, ids, np.frombuffer(b[f"n{side}"][i].as_buffer(), "<i8"))

        for b in batches:
            for i in range(b.num_rows):
                same = b["a"][i].as_py() == b["b"][i].as_py()
                out: list = []
                left = part(b, i, 1)
                join_parts(left, left if same else part(b, i, 2), eps, cosine, same, out)
                if out:
                    p, q, m, n = (np.concatenate(z) for z in zip(*out, strict=True))
                    ids, inverse = np.unique(np.concatenate([p, q]), return_inverse=True)
                    links = np.bincount(inverse, weights=np.concatenate([n, m])).astype(np.int64)
                    s, t = _spanning(p, q)
                    none = np.full(len(ids), None)
                    yield record_batch(["id", "links", "other"], [np.concatenate([ids, s]), np.concatenate([links, np.zeros(len(s), np.int64)]), pa.array([*none, *t.tolist()], pa.int64())])

    return work


def embedding_links(vectors: DataFrame, cosine: float = COSINE, grid_axes: int = GRID_AXES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding array).

    Vectors that are null, empty, zero, of another width than most, or that hold null or non-finite components link with nothing and are their own class. Repeated
    rows count as further vectors. Rows without vec_id are returned, linked with nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_scaled, "vec_id long, v binary")
    rows = written(rows.withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v"))), "scaled")
    widths = rows.where("v is not null").groupBy((F.octet_length("v") / 8).cast("int").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 1
    rows = rows.withColumn("v", F.when(F.octet_length("v") == 8 * width, F.col("v")))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    nodes = written(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors")
    axes = principal_axes(nodes, width)
    grid = min(grid_axes, width)
    total = nodes.count()
    ordered = nodes.select("id", "n", "v").mapInArrow(_cells(axes, eps, grid), "id long, n long, v binary, cell array<long>").repartitionByRange(max(1, -(-total // (8 * block))), *[F.col("cell")[k] for k in range(grid)], "id").sortWithinPartitions(*[F.col("cell")[k] for k in range(grid)], "id")
    blocks = written(ordered.select("id", "n", "v").mapInArrow(_block_rows(axes, eps, grid, block), "block long, low array<double>, high array<double>, ids binary, n binary, x binary"), "blocks", codec="none")
    cells = blocks.select("block", "low", "high").withColumn("c", F.expr(f"sequence(cast(floor(low[0] / {eps!r}) as int), cast(floor(high[0] / {eps!r}) as int))"))
    near = cells.select("block", "low", "high", F.explode(F.expr("sequence(element_at(c, 1) - 1, element_at(c, -1) + 1)")).alias("c"))
    far = " + ".join(f"power(greatest(0, a.low[{k}] - b.high[{k}], b.low[{k}] - a.high[{k}]), 2)" for k in range(grid))
    at = cells.select("block", "low", "high", F.explode("c").alias("c"))
    met = at.alias("a").join(near.alias("b"), F.expr(f"a.c = b.c and a.block <= b.block and {far} <= {eps * eps!r}")).select(F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct()
    one, two = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"{c}1") for c in ("ids", "n", "x")]), blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("ids", "n", "x")])
    pairs = met.join(one, "a").join(two, "b").repartition(max(spark.sparkContext.defaultParallelism, -(-total // (4 * block))))
    found = written(pairs.mapInArrow(_join_blocks(axes, eps, cosine), "id long, links long, other long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    told = nodes.join(links, "id", "left").join(classes, "id", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("v is not null").join(told, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
