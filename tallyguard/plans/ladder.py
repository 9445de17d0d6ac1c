"""Global ranks without a single-task sort.

Distinct values are counted first (ties collapse map-side), then range-partitioned and
staged together with their partition number. Each partition is ranked on its own and
shifted by the total of the partitions before it; that offset table has one row per
range of half a million rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import stage

_RANGE = "_range"
RANGE_ROWS = 500_000  # rows that one task ranks


def totals_before(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """All rows with ``<sum>_before`` per summed column: its total over the rows before, in ``order``.

    The number of ranges follows the number of rows, so that no range grows with the table.
    """
    rows = stage(df, f"{name}-rows")
    parts = 1 + rows.count() // RANGE_ROWS
    placed = stage(
        rows.repartitionByRange(parts, *order).withColumn(_RANGE, F.spark_partition_id()), name
    )
    per_range = placed.groupBy(_RANGE).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        _RANGE, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_offset") for c in sums]
    )
    local = (
        Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.join(offsets, _RANGE)
        .select(
            *df.columns,
            *[
                (F.col(f"_{c}_offset") + F.coalesce(F.sum(c).over(local), F.lit(0))).alias(
                    f"{c}_before"
                )
                for c in sums
            ],
        )
    )


def ladder(
    df: DataFrame,
    value: str,
    measures: dict[str, Column] | None = None,
    descending: bool = False,
) -> DataFrame:
    """One row per distinct value: ``n`` rows hold it, ``n_before`` rows come earlier.

    ``measures`` are further summed columns, each with its own ``_before`` total.
    """
    measures = measures or {}
    steps = (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(expr).alias(out) for out, expr in measures.items()],
        )
    )
    order = [F.desc(value) if descending else F.asc(value)]
    return totals_before(steps, order, ["n", *measures], f"ladder-{value}")


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number all rows from 1 in a global order."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = totals_before(one, order, ["_one"], f"numbered-{name}")
    return out.select(*df.columns, (F.col("_one_before") + 1).alias(name))


def attach_by_value(
    rows: DataFrame, steps: DataFrame, value: str, limit: int = 1_000_000, share: float = 1 / 5_000
) -> DataFrame:
    """Join ladder columns back to rows; values shared by many rows do not skew the join.

    All rows stay: those without a value get NULL ladder columns.

    Hot values hold more than ``share`` of the rows each, so at most ``1 / share`` of them
    are broadcast; every other value goes through an ordinary shuffle join.
    """
    total, top = steps.agg(F.sum("n"), F.max("n")).first()
    bar = max(limit, int((total or 0) * share))
    if not total or top <= bar:
        return rows.join(steps, value, "left")
    common = F.broadcast(steps.filter(F.col("n") > bar))
    rest = steps.filter(F.col("n") <= bar)
    usual = rows.join(common.select(value), value, "left_anti").join(rest, value, "left")
    return rows.join(common, value).unionByName(usual)
