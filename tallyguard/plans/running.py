"""Running totals over an account's timeline that survive a hot account.

``[t, t + w]`` sums and counts are differences of running totals read at ``t`` and
``t + w``. Rows that only read a total ("probes") are placed on the timeline next to
the events, so one sort answers every row in linear time; sliding RANGE frames, which
re-aggregate the frame for each row, are never needed.

A hot account's timeline is cut into chunks. What happened before a chunk enters it as
one carry row per (account, chunk), made from pre-aggregated chunk totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import CHUNK, HotKeys
from .stage import stage

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}
_CARRY = "_carry"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, tuple[str, str]],
    hot: HotKeys,
    include_self: bool = True,
    backwards: bool = False,
) -> DataFrame:
    """Add running aggregates ``{output: (sum|max|min, input column)}``.

    ``keys`` starts with the account column(s) and ``order`` starts with ``us``. With
    ``backwards`` time runs from late to early (the other order columns stay ascending).
    """
    frame_end = Window.currentRow if include_self else -1

    def clock(cols: list[str]) -> list[Column]:
        first = F.desc(cols[0]) if backwards else F.asc(cols[0])
        return [first, *[F.asc(c) for c in cols[1:]]]

    if not hot:
        window = (
            Window.partitionBy(*keys)
            .orderBy(*clock(order))
            .rowsBetween(Window.unboundedPreceding, frame_end)
        )
        return df.select(
            "*", *[_FOLD[kind](src).over(window).alias(out) for out, (kind, src) in totals.items()]
        )

    # an own input column per total, since its carry row brings that total's own value
    inputs = {out: f"_in_{out}" for out in totals}
    # staged, since the chunks' totals and their rows both read it
    chunked = stage(
        hot.split_in_order(df, keys, order, backwards).withColumns({inputs[out]: F.col(src) for out, (_, src) in totals.items()}),
        "timeline",
    )
    per_chunk = (
        chunked.filter(F.col(CHUNK) >= 0)
        .groupBy(*keys, CHUNK)
        .agg(*[_FOLD[kind](inputs[out]).alias(inputs[out]) for out, (kind, _) in totals.items()])
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.desc(CHUNK) if backwards else F.asc(CHUNK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_chunk.select(
        *keys,
        CHUNK,
        F.lit(0).alias(_CARRY),
        *[
            _FOLD[kind](inputs[out]).over(before).alias(inputs[out])
            for out, (kind, _) in totals.items()
        ],
    )
    window = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(F.asc(_CARRY), *clock(order))
        .rowsBetween(Window.unboundedPreceding, frame_end)
    )
    return (
        chunked.withColumn(_CARRY, F.lit(1))
        .unionByName(carry, allowMissingColumns=True)
        .select(
            *df.columns,
            _CARRY,
            *[_FOLD[kind](inputs[out]).over(window).alias(out) for out, (kind, _) in totals.items()],
        )
        .filter(F.col(_CARRY) == 1)
        .drop(_CARRY)
    )


def paired(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """Bring what a row's probes read back to that row.

    ``keys`` start with the account and name one row's probes, so without hot accounts
    the shuffle of :func:`running` is reused and each group holds a handful of rows.
    """
    window = Window.partitionBy(*keys)
    return df.select("*", *[F.max(expr).over(window).alias(out) for out, expr in columns.items()])
