"""Column expressions that several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"  # the six white-space characters that end a word
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the optimizer would inline it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) == 0, none).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def indices(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(numbers: Column) -> Column:
    """Sum of an array of integers; 0 for an empty one."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def running_sum(numbers: Column) -> Column:
    """Inclusive running sums of an array of bigints, by doubling: n log n steps."""
    return let(
        numbers,
        lambda xs: F.when(F.size(xs) < 2, xs).otherwise(
            F.aggregate(
                F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs))).cast("int")),
                xs,
                lambda acc, k: F.transform(
                    acc,
                    lambda x, i: x
                    + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)),
                ),
            )
        ),
    )
