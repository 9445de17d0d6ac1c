"""Timestamps: two explicit formats, microsecond clock, calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped


def is_slash_format(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("/")), F.lit(False))


def parse_timestamp(text: Column) -> Column:
    """``d/m/y h:m`` where a slash occurs, ISO to the second otherwise, else NULL."""
    t = stripped(text)
    return F.when(
        is_slash_format(t), F.try_to_timestamp(t, F.lit("d/M/yyyy H:m"))
    ).otherwise(F.try_to_timestamp(t, F.lit("yyyy-M-d H:m:s")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def calendar(ts: Column) -> dict[str, Column]:
    """Parts used by rules and features; weeks start on Monday with 0."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "date": F.to_date(ts),
    }
