"""Text columns: trimming, spelling folds, joined names, displayed numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(col: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def folded(col: Column, spellings: dict[str, str]) -> Column:
    """Map known spellings, case-blind, to one name; others stay as written, NULL stays NULL."""
    if not spellings:
        return stripped(col)
    pairs = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.coalesce(F.element_at(pairs, F.lower(stripped(col))), stripped(col))


def names_of(flags: dict[str, Column]) -> Column:
    """Names of the true flags in the given order, as an array."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))


def reason_text(flags: dict[str, Column]) -> Column:
    return F.array_join(names_of(flags), ", ")


def pounds(col: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(col, 0))


def whole(col: Column) -> Column:
    """Nearest whole number, half to even, without separators."""
    return F.bround(col, 0).cast("bigint").cast("string")


def reference(position: Column, prefix: str = "ALERT-") -> Column:
    """Neutral zero-padded reference; wider numbers keep all their digits."""
    return F.format_string(prefix + "%04d", position)
