"""Local outlier factor (Breunig et al., 2000) on exact nearest neighbours.

Neighbours come from a pivot-partitioned search (after Lu et al., 2012): points belong to
the cell of their nearest pivot; the neighbours near a point's own cell bound how far
the true ones can be, and only blocks of cells that could hold a closer one are compared.

- Copies of a point are one point with a weight, so a large group of identical rows is a
  single row here.
- Cells are staged in blocks of bounded size. A task holds some queries and reads one block
  after the other, so no task holds a whole cell and nothing is repeated in a shuffle. A task
  hands on at most k neighbours per point, never its pairs.
- Pivots are drawn from the points, dense regions get more of them. Their number is
  capped, which bounds what is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..plans import attach_by_value, stage

BLOCK = 2_048
CELL_POINTS = 512
MAX_PIVOTS = 2_048
LISTED = 50_000_000  # rows of a neighbour table that are joined at once
QUERIES = 8_192  # that one task looks up at most, two blocks more or less
_FOUND = pa.schema(
    [
        ("q", pa.int64()),
        ("o", pa.int64()),
        ("dist", pa.float64()),
        ("weight", pa.int64()),
    ]
)
_ARROW_BLOCK = pa.schema(
    [
        ("task", pa.int32()),
        ("cell", pa.int32()),
        ("block", pa.int32()),
        ("ids", pa.binary()),
        ("copies", pa.binary()),
        ("x", pa.binary()),
        ("away", pa.float64()),
    ]
)
_BLOCK_DDL = "task int, cell int, block int, ids binary, copies binary, x binary, away double"
_FOUND_DDL = "q bigint, o bigint, dist double, weight bigint"


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(rows, -1).astype(np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _collapse(rows: DataFrame) -> DataFrame:
    """``point`` (a number no other point has), ``x`` and the number of ``copies``.

    The numbers hold from the moment the rows are staged, as the caller does.
    """
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "point", F.monotonically_increasing_id()
    )


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """A bounded set of the points, picked by hash."""
    wanted = max(1, min(MAX_PIVOTS, math.ceil(n / CELL_POINTS)))
    width = 1 << 30
    share = min(1.0, (wanted + 4 * math.sqrt(wanted)) / n)
    draw = F.pmod(F.xxhash64("x", F.lit(7)), F.lit(width))
    rows = (
        points.filter(draw < math.ceil(width * share))
        .select("x", draw.alias("draw"), "point")
        .orderBy("draw", "point")
        .limit(wanted)
        .collect()
    )
    if not rows:  # very few points: any one of them serves
        rows = points.select("x").limit(1).collect()
    return np.array([r["x"] for r in rows], dtype=np.float64)


def _assigned(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot's number and the distance to it."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, away double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = distances(np.stack(x.to_numpy()).astype(np.float64), shared.value)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "away": d[np.arange(len(d)), cell]})

    return points.withColumn("n", nearest("x")).select(
        "point", "x", "copies", F.col("n.cell").alias("cell"), F.col("n.away").alias("away")
    )


def _closest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows per query; a weighted point counts as that many rows."""
    order = Window.partitionBy("q").orderBy("dist", "o")
    before = F.coalesce(
        F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("before", before)
        .filter(F.col("before") < k)
        .select("q", "o", "dist", F.least("weight", F.lit(k) - F.col("before")).alias("weight"))
    )


def _packed(cells: DataFrame, tasks: int) -> DataFrame:
    """Cells in blocks of about ``BLOCK`` points, a row each, dealt to ``tasks`` in order of their cells."""
    counts = sorted((r["cell"], r["count"]) for r in cells.groupBy("cell").count().collect())  # one per pivot
    share, before, dealt = sum(n for _, n in counts) / tasks, 0.0, []
    for cell, n in counts:
        blocks = math.ceil(n / BLOCK)
        dealt.append((cell, blocks, [min(tasks - 1, int((before + n * i / blocks) / share)) for i in range(blocks)]))
        before += n
    places = cells.sparkSession.createDataFrame(dealt, "cell int, blocks int, tasks array<int>")
    block = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("point", "copies")]
        flat = group.column("x").combine_chunks().flatten().to_numpy().astype(np.float32)
        row = {"task": group.column("task")[0].as_py(), "cell": key[0].as_py(), "block": key[1].as_py()}
        row |= {"ids": columns[0], "copies": columns[1], "x": flat.tobytes(), "away": max(group.column("away").to_pylist())}
        return pa.Table.from_pylist([row], schema=_ARROW_BLOCK)

    return (
        cells.join(F.broadcast(places), "cell")
        .withColumn("block", block)
        .withColumn("task", F.get("tasks", F.col("block")))
        .select("task", "cell", "block", "point", "x", "copies", "away")
        .groupBy("cell", "block")
        .applyInArrow(pack, _BLOCK_DDL)
    )


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, copies = (np.frombuffer(row[c], np.int64) for c in ("ids", "copies"))
    return ids, np.frombuffer(row["x"], np.float32).reshape(len(ids), -1).astype(np.float64), copies


class _Search:
    """The nearest ``k`` points of some queries among the blocks seen so far."""

    def __init__(self, parts: list, k: int, pivots: np.ndarray):
        self.k, self.pivots = k, pivots
        own = [_arrays(part) for part in parts]
        self.ids, self.x = (np.concatenate([o[i] for o in own]) for i in range(2))
        self.squares = (self.x * self.x).sum(1)
        self.reach = np.full(len(self.ids), np.inf)  # distance of the k-th point, where there are k
        self.found: list[list[np.ndarray]] = []
        self.pending = 0
        self.own = {(part["cell"], part["block"]) for part in parts}
        for part in parts:
            self.compare(part, True)

    def visit(self, block) -> None:
        if (block["cell"], block["block"]) not in self.own:
            self.compare(block, False)

    def compare(self, block, own: bool) -> None:
        gap = np.sqrt(((self.x - self.pivots[block["cell"]]) ** 2).sum(1)) - block["away"]
        asked = np.flatnonzero(gap <= self.reach + 1e-6 * (1 + self.reach))
        if not len(asked):
            return
        ids, x, copies = _arrays(block)
        squares = (x * x).sum(1)
        for first in range(0, len(asked), 1_024):
            some = asked[first : first + 1_024]
            d = self.squares[some, None] + squares[None, :] - 2.0 * (self.x[some] @ x.T)
            if own:  # a row is not its own neighbour, its copies are at no distance
                at = np.nonzero(self.ids[some, None] == ids[None, :])
                d[at] = np.where(copies[at[1]] > 1, 0.0, np.inf)
            limit = self.reach[some] ** 2 * (1 + 1e-9)
            if self.k < d.shape[1] and np.isinf(limit).any():
                limit = np.minimum(limit, np.maximum(np.partition(d, self.k - 1, axis=1)[:, self.k - 1], 0.0))
            q, o = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            weight = copies[o] - (self.ids[some[q]] == ids[o])
            self.found.append([some[q], ids[o], np.sqrt(np.maximum(d[q, o], 0.0)), weight])
            self.pending += len(q)
        if self.pending > max(len(self.ids) * self.k // 4, 1):
            self.settle()

    def settle(self) -> None:
        q, o, dist, weight = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((o, dist, q))
        q = q[order]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
        near = order[rank < self.k]
        self.found, self.pending = [[q[rank < self.k], o[near], dist[near], weight[near]]], 0
        last = order[rank == self.k - 1]
        self.reach[q[rank == self.k - 1]] = dist[last]

    def result(self) -> list[np.ndarray]:
        """``q, o, dist, weight``: a weighted point counts as that many rows."""
        self.settle()
        q, o, dist, weight = self.found[0]
        if not len(q):
            return [q.astype(np.int64), o, dist, weight]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        before = np.cumsum(weight) - weight
        before -= np.repeat(before[heads], np.diff(np.append(heads, len(q))))
        near = before < self.k
        return [self.ids[q[near]], o[near], dist[near], np.minimum(weight, self.k - before)[near]]


def neighbours(points: DataFrame, k: int = C.NEIGHBOURS) -> DataFrame:
    """Exact nearest neighbours of distinct points: ``q, o, dist, weight``.

    Every query's weights add up to ``k`` where there are that many other rows. A task holds its
    queries and reads the staged blocks one after the other, so neither points nor candidates are
    repeated in a shuffle; what is written are the ``k`` nearest of every point. Comparisons grow
    with the square of the points wherever cells cannot be told apart by distance.
    """
    spark = points.sparkSession
    n = points.count()
    if not n:
        return spark.createDataFrame([], _FOUND_DDL)
    pivots = _pivots(points, n)
    tasks = max(1, math.ceil(n / min(QUERIES, max(512, n // 64))))
    blocks = stage(_packed(stage(_assigned(points, pivots), "cells"), tasks), "blocks")
    parts = F.collect_list(F.struct("cell", "block", "ids", "copies", "x", "away")).alias("parts")
    queries = blocks.repartition(tasks, "task").groupBy("task").agg(parts)
    shared = spark.sparkContext.broadcast(pivots)

    def search(pairs):
        searches = {}
        for asked, block in pairs:
            if asked["task"] not in searches:
                searches[asked["task"]] = _Search(asked["parts"], k, shared.value)
            searches[asked["task"]].visit(block)
        for done in searches.values():
            yield tuple(bytearray(np.ascontiguousarray(v).tobytes()) for v in done.result())

    def unpacked(batches):
        kinds = (np.int64, np.int64, np.float64, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in enumerate(kinds)]
                for first in range(0, len(columns[0]), 65_536):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[first : first + 65_536]) for c in columns], schema=_FOUND
                    )

    found = queries.rdd.cartesian(blocks.coalesce(1).rdd).mapPartitions(search)
    packed = spark.createDataFrame(found, "q binary, o binary, dist binary, weight binary", verifySchema=False)
    return stage(packed.mapInArrow(unpacked, _FOUND_DDL), "neighbours")


def _sliced(near: DataFrame, slices: int, about: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``about`` says of the queries in ``near``, written for a slice of them at a time."""
    share = F.pmod(F.xxhash64("q"), F.lit(slices))
    written = [stage(about(near if slices == 1 else near.filter(share == i)), name) for i in range(slices)]
    return reduce(DataFrame.unionByName, written)


def outlier_factors(near: DataFrame) -> DataFrame:
    """``point, lof`` from a neighbour table: two self-joins on the neighbour.

    Long tables are joined in slices of their queries, each written before the next one.
    """
    reach = near.groupBy(F.col("q").alias("o")).agg(F.max("dist").alias("k_dist"))
    slices = max(1, math.ceil(near.count() / LISTED))
    reach = reach if slices == 1 else stage(reach, "reach")
    n = F.sum("weight")

    def densities(some: DataFrame) -> DataFrame:
        reached = F.sum(F.greatest("dist", "k_dist") * F.col("weight"))
        return some.join(reach, "o").groupBy("q").agg((1.0 / (reached / n + 1e-10)).alias("lrd"))

    density = _sliced(near, slices, densities, "density")
    around = density.select(F.col("q").alias("o"), F.col("lrd").alias("lrd_o"))

    def factors(some: DataFrame) -> DataFrame:
        mean = (F.sum(F.col("lrd_o") * F.col("weight")) / n).alias("mean_lrd")
        means = some.join(around, "o").groupBy("q").agg(mean)
        return means.join(density, "q").select(F.col("q").alias("point"), (F.col("mean_lrd") / F.col("lrd")).alias("lof"))

    return _sliced(near, slices, factors, "factors")


def local_outlier_factor(
    rows: DataFrame,
    columns: list[str] | str,
    k: int = C.NEIGHBOURS,
    search: Callable[[DataFrame, int], DataFrame] = neighbours,
) -> DataFrame:
    """Add ``lof`` to rows; ``columns`` are numeric columns or the name of a vector column.

    ``search`` finds the neighbours: :func:`neighbours` exactly,
    ``projection.projected_neighbours`` in bounded cells at any number of rows.
    """
    x = (
        F.col(columns).cast("array<float>")
        if isinstance(columns, str)
        else F.array(*[F.col(f"`{c}`").cast("float") for c in columns])
    )
    placed = rows.withColumn("_x", x)
    points = stage(_collapse(placed.select(F.col("_x").alias("x"))), "points")
    factors = outlier_factors(search(points, k))
    # vectors shared by many rows do not skew the join back
    by_vector = points.join(factors, "point").select(
        F.col("x").alias("_x"), "lof", F.col("copies").alias("n")
    )
    return attach_by_value(placed, by_vector, "_x").drop("_x", "n")
