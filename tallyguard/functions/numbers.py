"""Numbers: pennies, bands, safe ratios, bins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Money as whole pennies, so that sums do not depend on their order.

    NULL for what is no number of pennies (NaN, or beyond 64 bits).
    """
    return F.round(amount * 100).try_cast("bigint")


def in_band(amount: Column, threshold: float, low: float) -> Column:
    return (amount >= threshold * low) & (amount < threshold)


def at_least_share(part_cents: Column, share: str, of_cents: Column) -> Column:
    """``part >= share * whole`` on pennies, exactly: the share is a text fraction."""
    top, bottom = Decimal(share).as_integer_ratio()
    return part_cents * bottom >= of_cents * top


def is_whole(amount: Column) -> Column:
    return amount == F.floor(amount).cast("double")


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """Rounded quotient, NULL for a zero denominator."""
    return F.round(F.try_divide(top.cast("double"), bottom.cast("double")), digits)


def priority(pct: Column) -> Column:
    """Right-closed bins of a percentile; a row without one is low."""
    return F.when(pct.isNull() | (pct <= 0.90), "low").when(pct <= 0.99, "medium").otherwise("high")


def hashed_uniform(key: Column, seed: int, low: float, high: float) -> Column:
    """Uniform draw that depends on the key alone, not on partitions or run."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)
    return F.lit(float(low)) + unit * (high - low)
