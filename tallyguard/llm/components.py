"""Connected components of a link table by alternating large and small stars.

Each round points nodes at the smallest node seen nearby; the number of rounds grows with the
logarithm of the longest chain. Rounds are written to the shared folder, so a lost executor
costs one round at most. Nothing but two scalars per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (
        both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of ``links`` with the smallest node it can reach.

    Links are undirected; repeated links, links of a node with itself and links with a null
    end change nothing. An empty table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    edges = stage(
        links.filter(x != y)
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        tidy = lambda e: e.filter("a != b").distinct()
        edges = stage(tidy(_small(tidy(_large(edges)))), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
