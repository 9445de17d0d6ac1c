"""A mergeable quantile sketch of whole pennies, next to the exact ladder.

Values fall into cells that are as wide as a fixed share of the value: all but the leading
``bits + 1`` binary digits of the magnitude are dropped. A sketch is a table of cells and
counts, with at most ``2 * 64 * 2 ** bits`` rows however many values went in, so sketches of
days or of partitions are merged by adding counts, in any order and with the same result.

Errors, for every quantile: the value is off by less than ``2 ** -bits`` of itself, and the
rank by no more than the rows of one cell, which the result states (``rank_from``,
``rank_to``). Whole numbers throughout: no order of summation, no rounding changes a cell.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cents

BITS = 7


def _digits_dropped(magnitude: Column, bits: int) -> Column:
    length = F.length(F.bin(magnitude))
    return F.greatest(length - (bits + 1), F.lit(0))


def sketch(df: DataFrame, amount: str, keys: Iterable[str] = (), bits: int = BITS) -> DataFrame:
    """Cells ``[low, high]`` of pennies with their rows ``n``, per key.

    Amounts that are NULL, NaN or beyond 64 bits of pennies are in no cell.
    """
    keys = list(keys)
    value = F.col("_cents")
    magnitude = F.abs(value)
    base = F.expr("shiftleft(shiftright(abs(_cents), _dropped), _dropped)")
    end = base + F.expr("shiftleft(1L, _dropped) - 1")
    cells = (
        df.select(*keys, cents(F.col(amount)).alias("_cents"))
        .filter(value.isNotNull() & (value > -(2**63) + 1))
        .withColumn("_dropped", _digits_dropped(magnitude, bits))
        .select(
            *keys,
            F.when(value < 0, -end).otherwise(base).alias("low"),
            F.when(value < 0, -base).otherwise(end).alias("high"),
        )
    )
    return cells.withColumn("n", F.lit(1).cast("bigint")).transform(merged, keys)


def merged(sketches: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """One sketch of what several (a union of them) have seen."""
    return sketches.groupBy(*keys, "low", "high").agg(F.sum("n").alias("n"))


def quantiles(
    cells: DataFrame, probs: Iterable[float], keys: Iterable[str] = ()
) -> DataFrame:
    """Per key and probability the cell of the row at rank ``ceil(p * n)``, at least one.

    ``estimate`` is the middle of the cell in pennies (the value itself where the cell has
    one), ``rank_from`` and ``rank_to`` are the ranks that the cell's rows hold. A window per
    key sorts cells, whose number is bounded, never rows.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("low")
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = cells.withColumns({"rank_to": F.sum("n").over(order), "rows": total}).withColumn(
        "rank_from", F.col("rank_to") - F.col("n") + 1
    )
    # probabilities in millionths, so that ranks are whole-number arithmetic
    millionths = F.array(*[F.lit(round(p * 1_000_000)).cast("bigint") for p in probs])
    wanted = F.greatest(
        F.expr("cast((decimal(rows) * _millionth + 999999) div 1000000 as bigint)"),
        F.lit(1).cast("bigint"),
    )
    return (
        ranked.withColumn("_millionth", F.explode(millionths))
        .withColumn("rank", wanted)
        .filter(F.col("rank").between(F.col("rank_from"), F.col("rank_to")))
        .select(
            *keys,
            (F.col("_millionth") / 1_000_000).alias("p"),
            "rows",
            "rank",
            ((F.col("low") + F.col("high")) / 2).alias("estimate"),
            "low",
            "high",
            "rank_from",
            "rank_to",
        )
    )
