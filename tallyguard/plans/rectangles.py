"""Counting points in rectangles, and the first one in time, without listing pairs.

A query asks for the points of its key within a time range and a value range. Points are first put
in order of key, time slot and value; a query's values are then a range of places in at most two
slots. The range is taken apart into nodes of sizes 1, 2, 4, ... as in a segment tree, and a point
belongs to one node of each size that its slot needs. In order of node and time, the points of a
rectangle are the difference of two running totals, and the next point after the first of them is
the earliest. Both orders are global and cut into ranges of bounded size, so neither a hot key nor
a hot instant meets in one task: rows are those of points and queries, times the logarithm of the
largest range, however many pairs there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ladder import totals_before
from .stage import stage


def count_in_ranges(queries: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points ``(key, us, value, id)`` that each of ``queries(key, us, lo, hi)`` meets.

    A point is met if it has the same key, lies after ``us`` and at most ``width`` later, and its
    value is between ``lo`` and ``hi``, both included. Result: the distinct queries that meet any,
    with ``met``, their number, and ``first``, the time and id of the earliest (the smallest id
    among those of one time). Rows with a null key, time or value meet nothing.
    """
    slot = lambda us: F.floor(us / F.lit(width))
    known = points.dropna(subset=["key", "us", "value"]).groupBy("key", "us", "value")
    known = known.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    asked = queries.dropna(subset=["key", "us", "lo", "hi"]).distinct()
    asked = stage(asked.withColumn("query", F.monotonically_increasing_id()), "rectangles")
    near = F.array_distinct(F.array(slot(F.col("us") + 1), slot(F.col("us") + F.lit(width))))
    wanted = asked.withColumn("slot", F.explode(near))

    # places of the value bounds among the points of a slot
    one = F.lit(1).cast("bigint")
    found = known.select("key", slot(F.col("us")).alias("slot"), "value", F.lit(0).alias("kind"), "us", "n", "id")
    bounds = [
        wanted.select("key", "slot", F.col(bound).alias("value"), F.lit(kind).alias("kind"), "us", "query")
        for bound, kind in (("lo", -1), ("hi", 1))
    ]
    rows = found.withColumn("one", one)
    for bound in bounds:
        rows = rows.unionByName(bound.withColumn("one", one - 1), allowMissingColumns=True)
    order = [F.asc(c) for c in ("key", "slot", "value", "kind", "us")]
    placed = stage(totals_before(rows, order, ["one"], "rectangle-values"), "rectangle-places")
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("one_before")))
    ranges = placed.filter("kind <> 0").groupBy("query", "key", "slot", "us").agg(at(-1).alias("a"), at(1).alias("b"))
    ranges = ranges.filter("b > a").withColumn("top", F.length(F.bin(F.col("b") - F.col("a"))) - 1)
    ranges = stage(ranges, "rectangle-ranges")

    # the nodes that make up a range, and those a point belongs to
    levels = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")
    nodes = (
        ranges.select("query", "us", "a", "b", levels)
        .selectExpr("*", "shiftright(a + shiftleft(1L, level) - 1, level) AS l", "shiftright(b, level) AS r")
        .filter("l < r")
        .selectExpr(
            "query", "level", "us",
            "explode(array_compact(array(if(l % 2 = 1, l, NULL), if(r % 2 = 1, r - 1, NULL)))) AS node",
        )
    )
    deepest = ranges.groupBy("key", "slot").agg(F.max("top").alias("top"))
    members = (
        placed.filter("kind = 0")
        .join(deepest, ["key", "slot"])
        .select(levels, F.col("one_before").alias("place"), "us", "n", "id", F.lit(0).alias("kind"))
        .selectExpr("level", "shiftright(place, level) AS node", "us", "n", "id", "kind")
    )
    ends = F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("us").alias("us")),
                             F.struct(F.lit(2).alias("kind"), (F.col("us") + F.lit(width)).alias("us"))))
    probes = nodes.select("query", "level", "node", ends.alias("e")).select(
        "query", "level", "node", "e.kind", "e.us", F.lit(0).cast("bigint").alias("n")
    )
    order = [F.asc(c) for c in ("level", "node", "us", "kind", "id")]
    timed = totals_before(members.unionByName(probes, allowMissingColumns=True), order, ["n"], "rectangle-times")
    timed = stage(timed, "rectangle-totals")
    total = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n_before")))
    hits = timed.filter("kind > 0").groupBy("query", "level", "node").agg(total(1).alias("s"), total(2).alias("e"))
    # the point with this running total is the next one after the first probe
    following = timed.filter("kind = 0").select(F.col("n_before").alias("s"), F.struct("us", "id").alias("next"))
    met = (
        hits.filter("e > s")
        .join(following, "s")
        .groupBy("query")
        .agg(F.sum(F.col("e") - F.col("s")).alias("met"), F.min("next").alias("first"))
    )
    return asked.join(met, "query").drop("query")
