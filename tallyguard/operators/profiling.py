"""Profile of a raw feed, as tables; everything is read as text and nothing is fixed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numbers import in_band
from ..functions.timestamps import is_slash_format
from ..plans import ladder
from .cleaning import standardised


def amount_of(df: DataFrame) -> Column:
    """Amount as a number, NULL where it cannot be read."""
    return F.expr("try_cast(amount AS double)")


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per level, NULL being a level."""
    return df.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def missing_values(raw: DataFrame) -> DataFrame:
    """Columns with NULL or empty cells, all counted in one pass."""
    counts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias("missing"),
        )
        for c in raw.columns
    ]
    return raw.agg(F.array(*counts).alias("m")).select(F.inline("m")).filter("missing > 0")


def _versions(raw: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies."""
    return raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_summary(raw: DataFrame) -> DataFrame:
    """Repeated ids, the rows they cover and how many of those are identical throughout."""
    per_id = (
        _versions(raw)
        .groupBy("transaction_id")
        .agg(
            F.sum("copies").alias("rows"),
            F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("identical"),
        )
    )
    zero = F.lit(0)
    return per_id.filter(F.col("rows") > 1).agg(
        F.count(F.lit(1)).alias("duplicated_ids"),
        F.coalesce(F.sum("rows"), zero).alias("rows_covered"),
        F.coalesce(F.sum("identical"), zero).alias("identical_rows"),
    )


def duplicate_rows(raw: DataFrame, limit: int | None = 10) -> DataFrame:
    """Rows whose id repeats, in id order; ``limit`` makes it a sample for reading."""
    repeated = (
        raw.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    rows = raw.join(repeated, "transaction_id", "left_semi")
    return rows.orderBy(*raw.columns).limit(limit) if limit else rows


def duplicate_differences(raw: DataFrame) -> DataFrame:
    """Per column, the repeated ids whose copies disagree in it."""
    others = [c for c in raw.columns if c != "transaction_id"]
    per_id = (
        _versions(raw)
        .groupBy("transaction_id")
        .agg(
            F.count(F.lit(1)).alias("versions"),
            *[F.min(F.struct(c)).alias(f"lo_{c}") for c in others],
            *[F.max(F.struct(c)).alias(f"hi_{c}") for c in others],
        )
        .filter("versions > 1")
    )
    counts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(~F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}"))).alias("ids_that_differ"),
        )
        for c in others
    ]
    return per_id.agg(F.array(*counts).alias("m")).select(F.inline("m"))


def negative_amounts(raw: DataFrame) -> DataFrame:
    amount = amount_of(raw)
    return raw.select(amount.alias("amount")).filter("amount < 0").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("amount").alias("lowest"),
        F.max("amount").alias("highest"),
    )


def negative_by_type(raw: DataFrame) -> DataFrame:
    return level_counts(raw.filter(amount_of(raw) < 0), "transaction_type")


def percentile_columns(rows: int, value: str, probs: Iterable[float]) -> dict[float, Column]:
    """Interpolated percentiles as aggregates over the steps of a ladder of ``rows`` rows."""

    def at(position: int) -> Column:
        inside = (F.col("n_before") <= position) & (F.col("n_before") + F.col("n") > position)
        return F.max(F.when(inside, F.col(value)))

    out = {}
    for p in probs:
        exact = (rows - 1) * p
        low = int(exact)
        high = min(low + 1, rows - 1)
        out[p] = at(low) + (at(high) - at(low)) * (exact - low)
    return out


def distribution(
    df: DataFrame, value: str, probs: Iterable[float] = (0.5, 0.9, 0.99, 0.999)
) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles of a numeric column.

    Everything is taken from the ladder of distinct values, so no task holds the column.
    """
    steps = ladder(df, value, {"total": F.col(value)})
    rows = steps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not rows:
        rows = 1
    x, n = F.col(value), F.col("n")
    mean = F.sum(x * n) / F.sum(n)
    basics = steps.agg(
        F.sum("n").alias("count"),
        mean.alias("mean"),
        F.min(x).alias("min"),
        *[
            c.alias("p" + f"{p * 100:g}".replace(".", "_"))
            for p, c in percentile_columns(rows, value, probs).items()
        ],
        F.max(x).alias("max"),
    )
    centre = basics.select("mean").scalar()
    spread = steps.agg(
        F.sqrt(F.try_divide(F.sum((x - centre) * (x - centre) * n), F.sum("n") - 1)).alias("std")
    )
    return basics.withColumn("std", spread.scalar())


def amount_distribution(raw: DataFrame, large: float = C.LARGE_AMOUNT) -> DataFrame:
    """Positive amounts; rows above ``large`` are counted, never cut off."""
    amounts = raw.select(amount_of(raw).alias("amount")).filter("amount > 0")
    above = amounts.agg(F.count_if(F.col("amount") > large).alias("n"))
    return distribution(amounts, "amount").withColumn("rows_above_large", above.scalar())


def timestamp_formats(raw: DataFrame) -> DataFrame:
    """Rows per format, and the first component of slash dates as day-first evidence."""
    slash = is_slash_format(F.col("timestamp"))
    first = F.when(slash, F.expr("try_cast(substring(timestamp, 1, 2) AS int)"))
    return raw.agg(
        F.count_if(~slash).alias("iso_rows"),
        F.count_if(slash).alias("slash_rows"),
        F.min(first).alias("first_component_min"),
        F.max(first).alias("first_component_max"),
    )


def country_spellings(raw: DataFrame) -> DataFrame:
    """Rows per spelling over both legs."""
    both = raw.select(F.explode(F.array("sender_country", "receiver_country")).alias("country"))
    return level_counts(both, "country")


def canonical_countries(customers: DataFrame) -> DataFrame:
    return customers.select("home_country").distinct()


def portfolio_countries(customers: DataFrame) -> DataFrame:
    return level_counts(customers, "home_country")


def category_counts(
    raw: DataFrame, columns: Iterable[str] = ("currency", "transaction_type", "channel")
) -> DataFrame:
    """Levels of several columns in one grouping."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns]
    )
    return raw.select(F.explode(cells).alias("c")).groupBy("c.column", "c.level").agg(
        F.count(F.lit(1)).alias("n")
    )


def id_prefixes(raw: DataFrame, length: int = 4) -> DataFrame:
    """Rows per id prefix: an id that gives its class away must not become a feature."""
    return level_counts(
        raw.select(F.substring("transaction_id", 1, length).alias("prefix")), "prefix"
    )


def account_activity(raw: DataFrame, customers: DataFrame) -> DataFrame:
    """Senders, payments per sender, and accounts the customer file does not know.

    Per-account counts take few distinct values (at most about the root of the row
    count), so the exact percentiles run over counts of counts.
    """
    per_count = (
        raw.filter("sender_account IS NOT NULL")
        .groupBy("sender_account")
        .agg(F.count(F.lit(1)).alias("sent"))
        .groupBy("sent")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    accounts = raw.select(
        F.explode(F.array("sender_account", "receiver_account")).alias("account_id")
    ).distinct()
    unknown = accounts.join(customers, "account_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return per_count.agg(
        F.sum("n").alias("senders"),
        F.expr("percentile(sent, 0.5, n)").alias("sent_median"),
        F.expr("percentile(sent, 0.99, n)").alias("sent_p99"),
        F.max("sent").alias("sent_max"),
    ).withColumn("accounts_not_in_customers", unknown.scalar())


def imputation_agreement(
    raw: DataFrame, customers: DataFrame, spellings: dict[str, str] | None = None
) -> DataFrame:
    """How often a known sender country equals the account's home country.

    Pairs of (account, country) are counted before the lookup, so a busy account meets
    the customer file once per country rather than once per payment.
    """
    known = (
        standardised(raw, spellings)
        .filter("sender_country IS NOT NULL")
        .groupBy("sender_account", "sender_country")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    homes = customers.groupBy(F.col("account_id").alias("sender_account")).agg(
        F.min("home_country").alias("home")
    )
    same = F.coalesce(F.col("sender_country") == F.col("home"), F.lit(False))
    return known.join(homes, "sender_account", "left").agg(
        F.sum("n").alias("known_rows"),
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("agreeing_rows"),
        F.round(F.sum(F.when(same, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias(
            "agreement"
        ),
    )


def amount_bands(book: DataFrame, threshold: float = C.REPORTING_THRESHOLD) -> DataFrame:
    """Payments per band around the reporting threshold, and whole multiples."""
    a = F.col("amount")
    bands = {
        "70-100% of threshold": in_band(a, threshold, 0.70),
        "90-100% of threshold": in_band(a, threshold, 0.90),
        "at or above threshold": a >= threshold,
        "multiples of 1000": (a % 1000 == 0) & (a >= 1000),
        "multiples of 500": (a % 500 == 0) & (a >= 500),
        "whole amounts from 1000": (a == F.round(a, 0)) & (a >= 1000),
    }
    counts = [
        F.struct(F.lit(name).alias("band"), F.count_if(test).alias("n"))
        for name, test in bands.items()
    ]
    return book.agg(F.array(*counts).alias("m")).select(F.inline("m"))


def histogram(
    df: DataFrame, value: Column, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Rows per equal-width bin (numbered from 1); the last bin includes its upper edge.

    Without ends the bins span the values' own range. Values beyond given ends count in the
    first or the last bin; every row with a value is counted.
    """
    rows = df.select(F.nullif(value, F.lit(float("nan"))).alias("x")).filter("x IS NOT NULL")
    if low is None or high is None:
        ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        low = ends["lo"] if low is None else low
        high = ends["hi"] if high is None else high
    width = ((high or 0.0) - (low or 0.0)) / bins or 1.0
    slot = F.floor((F.col("x") - F.lit(float(low or 0.0))) / F.lit(width)) + 1
    clipped = F.greatest(F.least(slot, F.lit(bins).cast("bigint")), F.lit(1).cast("bigint"))
    return rows.groupBy(clipped.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def busiest(book: DataFrame, column: str, n: int = 6) -> DataFrame:
    """The ``n`` levels with most rows, ties by name."""
    return level_counts(book, column).orderBy(F.desc("n"), "level").limit(n)


def first_rows_of_busiest(book: DataFrame, n: int = 8) -> DataFrame:
    """The first payments of the most active sender."""
    top = busiest(book, "sender_account", 1).select(F.col("level").alias("sender_account"))
    return (
        book.join(F.broadcast(top), "sender_account", "left_semi")
        .orderBy("timestamp", "transaction_id")
        .limit(n)
    )



def level_leak(raw: DataFrame, column: str, level: str, prefix: int = 3) -> DataFrame:
    """Whether a stray level gives its rows away: what all, or any, of them have in common.

    An unknown country is no domestic leg. Without such rows there is nothing to say: nulls.
    """
    rows = raw.filter(F.col(column) == level)
    start = F.substring("transaction_id", 1, prefix)
    domestic = F.coalesce(F.col("sender_country") == F.col("receiver_country"), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(start) == F.max(start)).alias("all_share_prefix"),
        F.bool_and(domestic).alias("all_domestic"),
        F.bool_or(domestic).alias("any_domestic"),
        F.bool_and(F.col("channel").isNotNull()).alias("all_have_channel"),
    )


def values_at_ranks(df: DataFrame, value: str, ranks: DataFrame) -> DataFrame:
    """The exact value at each ``rank`` (from 1) of a small table of ranks, by the ladder."""
    steps = ladder(df, value, {"total": F.col(value)})
    inside = (F.col("rank") > F.col("n_before")) & (F.col("rank") <= F.col("n_before") + F.col("n"))
    return steps.join(F.broadcast(ranks.select("rank").distinct()), inside).select(
        "rank", F.col(value).alias("value")
    )
