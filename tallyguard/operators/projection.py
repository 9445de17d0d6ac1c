"""Nearest neighbours of many points in many dimensions, by a forest of random projections.

Every table cuts the points in halves along random directions until a cell holds about ``LEAF``
of them; points near each other share a cell in most tables. Distances inside cells are exact, and
a point's neighbours are the nearest it met in any table. What is missed is measured, not guessed:
see :func:`recall`.

Cells stay bounded at any number of points. The cuts of a cell are medians of a bounded sample of
its rows, up to ten halvings a round; cells that are still too large are cut again in the next
round, each with cuts of its own. A point carries its cells in all tables, so a pair is listed by the
first table in which it meets and by no other. Cells whose points cannot be told apart by a
projection are worked off in tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..plans import discard, passing, stage
from .lof import BLOCK, _closest, distances

TABLES = 8
LEAF = 1_024
HALVINGS = 10  # of a round
SAMPLED = 32  # rows whose median cuts a cell
ROUNDS = 6  # ten bits of a cell's number each
MERGED = 4_000  # points whose neighbours one task merges at once
AT_ONCE = 4_000_000  # points times tables whose neighbours are found before they are merged
_LISTS = "q bigint, o array<bigint>, dist array<double>, weight array<bigint>"
_NEAR = "q bigint, o bigint, dist double, weight bigint"


def _directions(dims: int, table: int, done: int) -> np.ndarray:
    """One random direction per halving, the same for all cells of a table."""
    draw = np.random.Generator(np.random.Philox(key=[table, done]))
    return draw.normal(size=(dims, HALVINGS))


def _cuts(group: pa.Table) -> pa.Table:
    """Medians of the sampled rows of a cell, as a heap: the halves of node i are 2i and 2i + 1."""
    depth = group.column("depth")[0].as_py()
    at = group.column("at").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
    cuts, node = np.full((1 << depth) - 1, np.nan), np.ones(len(at), np.int64)
    for level in range(depth):
        values = at[:, level]
        order = np.lexsort((values, node))
        nodes, first, n = np.unique(node[order], return_index=True, return_counts=True)
        cuts[nodes - 1] = values[order][first + (n - 1) // 2]
        node = 2 * node + (values > cuts[node - 1])
    own = group.select(["table", "cell"]).slice(0, 1)
    return own.append_column("cuts", pa.array([cuts.tolist()], pa.list_(pa.float64())))


def _heaps(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per table the sorted cells to be cut, their depths and their cuts (no cuts: a depth of 0)."""
    out = {}
    for table in {r["table"] for r in rows}:
        own = sorted((r["cell"], r["depth"], r["cuts"]) for r in rows if r["table"] == table)
        cuts = np.full((len(own), (1 << max(depth for _, depth, _ in own)) - 1), np.nan)
        for i, (_, depth, values) in enumerate(own):
            cuts[i, : (1 << depth) - 1] = [np.nan if v is None else v for v in values or []] or np.nan
        out[table] = (np.array([c for c, *_ in own]), np.array([d if v else 0 for _, d, v in own]), cuts)
    return out


def _finer(turn: int, halvings: int, shared):
    """The cells of points after a round, from those before."""

    def finer(x: pa.Array, cells: pa.Array) -> pa.Array:
        points = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.float64)
        old = cells.flatten().to_numpy().reshape(len(cells), -1)
        new = old << halvings
        for table, (known, depth, heap) in shared.value.items():
            place = np.minimum(np.searchsorted(known, old[:, table]), len(known) - 1)
            levels = np.where(known[place] == old[:, table], depth[place], 0)
            at = points @ _directions(points.shape[1], table, turn)
            node = np.ones(len(points), np.int64)
            for level in range(levels.max(initial=0)):
                goes = levels > level
                above = at[goes, level] > heap[place[goes], node[goes] - 1]
                node[goes] = 2 * node[goes] + above
            new[:, table] += node - (1 << levels)
        offsets = pa.array(np.arange(0, new.size + 1, new.shape[1], dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(new.ravel()))

    return finer


def _with_cells(points: DataFrame, dims: int, tables: int, leaf: int) -> DataFrame:
    """``points`` with the array ``cells``, the number of their cell in each table.

    A point is written once a round, whatever the number of tables. The cuts of a round are
    collected and shipped with the tasks: a number per table for every ``leaf`` points.
    """
    session = points.sparkSession
    now = points.select("point", "x", "copies", F.array_repeat(F.lit(0).cast("bigint"), tables).alias("cells"))
    before = None
    for turn in range(ROUNDS):
        sizes = now.select(F.posexplode("cells").alias("table", "cell")).groupBy("table", "cell").count()
        large = sizes.filter(F.col("count") > 2 * leaf).collect()
        top = max((r["count"] for r in large), default=None)
        if top is None or top == before:
            break
        before = top
        deep = [(r["table"], r["cell"], r["count"], min(HALVINGS, math.ceil(math.log2(r["count"] / leaf)))) for r in large]
        sampled_at = session.sparkContext.broadcast(
            {t: sorted((c, n, d) for table, c, n, d in deep if table == t) for t in {r[0] for r in deep}}
        )

        def sample(batches, turn=turn, sampled_at=sampled_at):
            for batch in batches:
                x, cells, draws = (
                    batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("x", "cells", "draws")
                )
                for table, rows in sampled_at.value.items():
                    known, n, depth = (np.array(v) for v in zip(*rows))
                    place = np.minimum(np.searchsorted(known, cells[:, table]), len(known) - 1)
                    drawn = draws[:, table] / float(1 << 30) * n[place] < SAMPLED * 2.0 ** depth[place]
                    some = np.flatnonzero(drawn & (known[place] == cells[:, table]))
                    at = x[some].astype(np.float64) @ _directions(dims, table, turn)
                    columns = [np.full(len(some), table, np.int32), cells[some, table], depth[place[some]].astype(np.int32)]
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)), pa.array(at.ravel())
                    )
                    names = ["table", "cell", "depth", "at"]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], lists], names)

        draws = F.array(*[F.pmod(F.xxhash64("point", F.lit(t)), F.lit(1 << 30)) for t in range(tables)])
        sampled = now.select("x", "cells", draws.alias("draws")).mapInArrow(
            sample, "table int, cell bigint, depth int, at array<double>"
        )
        cut = sampled.groupBy("table", "cell").applyInArrow(_cuts, "table int, cell bigint, cuts array<double>")
        cuts = {(r["table"], r["cell"]): r["cuts"] for r in cut.collect()}
        # cells without a sampled row are left whole, for the next round or the tiles
        rows = [{"table": t, "cell": c, "depth": d, "cuts": cuts.get((t, c))} for t, c, _, d in deep]
        shared = session.sparkContext.broadcast(_heaps(rows))

        cells = F.arrow_udf(_finer(turn, HALVINGS, shared), "array<bigint>")("x", "cells")
        finer = stage(now.select("point", "x", "copies", cells.alias("cells")), "cells")
        if turn:
            discard(now)
        now = finer
    return now


def _cells(points: DataFrame, dims: int, tables: int, leaf: int) -> DataFrame:
    """(table, cell, earlier, point, x, copies): every point once per table.

    ``earlier`` are the point's cells in the tables before this one.
    """
    each = _with_cells(points, dims, tables, leaf).select("*", F.posexplode("cells").alias("table", "cell"))
    earlier = F.slice("cells", F.lit(1), F.col("table")).alias("earlier")
    return each.select("table", "cell", earlier, "point", "x", "copies")


def _tile(k: int):
    """Neighbours of the points of one block among those of another, both ways.

    Two points that share a cell of an earlier table have met there, and are not listed again.
    """

    def nearest(ids, x, copies, earlier, left: np.ndarray, right: np.ndarray, own: np.ndarray | None) -> list[pa.Array]:
        """``own`` are the places of the left points among the right ones, if they are there."""
        to = x[right]
        squares = (to * to).sum(1)[None, :] - 2.0 * (x[left] @ to.T) + (x[left] ** 2).sum(1)[:, None]
        at = np.arange(len(left))[:, None]
        if own is not None:  # a row is not its own neighbour, its copies are at no distance
            squares[at[:, 0], own] = np.where(copies[left] > 1, 0.0, np.inf)
        take = min(k, len(right))
        best = np.argpartition(squares, take - 1, axis=1)[:, :take]
        weight = copies[right][best] - (ids[right][best] == ids[left][:, None])
        dist = np.sqrt(np.maximum(squares[at, best], 0.0))
        new = np.isfinite(dist)
        for cell in earlier.T:
            new &= cell[left][:, None] != cell[right][best]
        offsets = pa.array(np.concatenate([[0], np.cumsum(new.sum(1))]), pa.int32())
        lists = (ids[right][best][new], dist[new], weight[new].astype(np.int64))
        return [pa.array(ids[left]), *[pa.ListArray.from_arrays(offsets, pa.array(v)) for v in lists]]

    def work(key: tuple, group: pa.Table) -> pa.Table:
        i, j = (v.as_py() for v in key[2:])
        block, ids = group.column("block").to_numpy(), group.column("point").to_numpy()
        x = group.column("x").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).astype(np.float64)
        copies = group.column("copies").to_numpy()
        earlier = group.column("earlier").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        names = ["q", "o", "dist", "weight"]
        parts = []
        for left, right in [(a, b)] if i == j else [(a, b), (b, a)]:
            for first in range(0, len(left) if len(right) else 0, 512):
                some = left[first : first + 512]
                own = first + np.arange(len(some)) if i == j else None
                parts.append(pa.table(nearest(ids, x, copies, earlier, some, right, own), names=names))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
        return pa.concat_tables(parts) if parts else pa.schema(list(zip(names, kinds))).empty_table()

    return work


def _merged(k: int, listed: bool):
    """The nearest of what some points have met, in lists for the tables to come or a row each."""

    def work(group: pa.Table) -> pa.Table:
        lists = [group.column(c).combine_chunks() for c in ("o", "dist", "weight")]
        sizes = np.diff(lists[0].offsets.to_numpy())
        q = np.repeat(group.column("q").to_numpy(), sizes)
        o, dist, weight = (x.flatten().to_numpy() for x in lists)
        keep = np.isfinite(dist)
        q, o, dist, weight = q[keep], o[keep], dist[keep], weight[keep]
        order = np.lexsort((dist, o, q))
        q, o, dist, weight = q[order], o[order], dist[order], weight[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (o[1:] != o[:-1])  # a pair that met in several tables
        q, o, dist, weight = q[new], o[new], dist[new], weight[new]
        order = np.lexsort((o, dist, q))
        q, o, dist, weight = q[order], o[order], dist[order], weight[order]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.array([], int)
        runs = np.diff(np.append(heads, len(q)))
        before = np.cumsum(weight) - weight
        before -= np.repeat(before[heads], runs)
        near = before < k
        weight = np.minimum(weight, k - before)
        q, columns = q[near], {"o": o[near], "dist": dist[near], "weight": weight[near]}
        if not listed:
            return pa.table({"q": q, **columns})
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.array([], int)
        offsets = pa.array(np.append(heads, len(q)), pa.int32())
        return pa.table({"q": q[heads], **{c: pa.ListArray.from_arrays(offsets, pa.array(v)) for c, v in columns.items()}})

    return work


def projected_neighbours(
    points: DataFrame, k: int = C.NEIGHBOURS, tables: int = TABLES, leaf: int = LEAF
) -> DataFrame:
    """Nearest neighbours of distinct ``points(point, x, copies)``: ``q, o, dist, weight``.

    Distances are exact, the choice is approximate. A point's weights add up to ``k`` wherever its
    cells hold that many other rows; a null or empty vector is not allowed. With many points the
    tables follow one another, and what a point has met is cut to its nearest after each, so that
    disks never hold what it met in all of them.
    """
    n, dims = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return points.sparkSession.createDataFrame([], _NEAR)
    at_once = max(1, min(tables, AT_ONCE // n))
    with passing(points.sparkSession) as keep:
        cells = _cells(points, dims, tables, leaf)
        # only cells that no projection parts are listed, as their points are alike
        sizes = cells.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        crowded = F.broadcast(stage(sizes.filter("blocks > 1"), "cells-crowded"))
        bucket = F.pmod(F.xxhash64("q"), F.lit(max(1, math.ceil(n / MERGED)))).alias("bucket")
        best = None
        for first in range(0, tables, at_once):
            some = cells.filter(F.col("table").between(first, first + at_once - 1))
            found = _met(some, crowded, k)
            if best is not None:
                found = found.unionByName(best)
            last = first + at_once >= tables
            merged = found.select(bucket, "q", "o", "dist", "weight").groupBy("bucket")
            before, best = best, stage(merged.applyInArrow(_merged(k, not last), _NEAR if last else _LISTS), "projected")
            if before is not None:
                discard(before)
        return keep(best)


def _met(cells: DataFrame, crowded: DataFrame, k: int) -> DataFrame:
    """``q`` with lists of the nearest that it meets in some tables."""
    placed = cells.join(crowded, ["table", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")
    tiled = placed.withColumn("block", block)
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = tiled.select("table", "cell", "i", "j", "block", "earlier", "point", "x", "copies")
    return rows.groupBy("table", "cell", "i", "j").applyInArrow(_tile(k), _LISTS)


def recall(points: DataFrame, near: DataFrame, k: int = C.NEIGHBOURS, queries: int = 256) -> float:
    """Share of the true neighbours of some points (picked by hash) that ``near`` holds.

    ``queries`` points at most are compared with every point, in batches.
    """
    picked = points.select("point", "x").orderBy(F.xxhash64("point", F.lit(3)), "point").limit(queries).collect()
    if not picked:
        return 1.0
    ids = np.array([r["point"] for r in picked])
    asked = np.array([r["x"] for r in picked], dtype=np.float64)

    def against(batches):
        for batch in batches:
            rows = pa.table({c: batch.column(c) for c in batch.schema.names})
            x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(np.float64)
            own = rows.column("point").to_numpy()
            d = distances(asked, x)
            weight = rows.column("copies").to_numpy()[None, :] - (ids[:, None] == own[None, :])
            d = np.where(weight > 0, d, np.inf)
            take = min(k, d.shape[1])
            best = np.argpartition(d, take - 1, axis=1)[:, :take]
            at = np.arange(len(ids))[:, None]
            columns = [np.repeat(ids, take), own[best].ravel(), d[at, best].ravel(), weight[at, best].ravel()]
            ok = np.isfinite(columns[2])
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in columns], ["q", "o", "dist", "weight"])

    exact = _closest(points.select("point", "x", "copies").mapInArrow(against, _NEAR), k)
    limit = exact.groupBy("q").agg(F.max("dist").alias("limit"), F.sum("weight").alias("true"))
    held = near.join(limit, "q").filter(F.col("dist") <= F.col("limit") * (1 + 1e-9) + 1e-6)
    met = held.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    return met / limit.agg(F.sum("true")).first()[0]
