"""Cleaning: one lineage that yields the clean book, the quarantine and the log.

Each raw row is traced through two grouped de-duplications. Grouping keeps one small
buffer per key and combines map-side, so a payment replayed a billion times costs no
more than one replayed twice; the counts the log needs ride along in the same groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COUNTRY_SPELLINGS, LARGE_AMOUNT
from ..functions.text import folded
from ..functions.timestamps import calendar, parse_timestamp
from ..plans import HotKeys, find_hot
from ..sources.schemas import RAW_COLUMNS

REASON = "quarantine_reason"
VERDICT, KEPT, REJECTED = "verdict", "kept", "quarantined"
_UNREADABLE = "unreadable"
_COUNTERS = ("raw_rows", "raw_unparsed", "raw_imputed", "raw_no_channel")


def with_derived(df: DataFrame) -> DataFrame:
    """Columns the rules and the features use."""
    ts = F.col("timestamp")
    return df.withColumns(
        {
            "is_cross_border": F.coalesce(
                F.col("sender_country") != F.col("receiver_country"), F.lit(True)
            ).cast("int"),
            **calendar(ts),
        }
    )


def standardised(raw: DataFrame, spellings: dict[str, str] | None = None) -> DataFrame:
    """Typed timestamps and folded country names; the original NULLs stay NULL, and a NaN
    amount, which is how a file spells a missing one, becomes NULL."""
    spellings = COUNTRY_SPELLINGS if spellings is None else spellings
    return raw.withColumns(
        {
            "timestamp": parse_timestamp(F.col("timestamp")),
            "amount": F.nullif(F.col("amount"), F.lit(float("nan"))),
            "sender_country": folded(F.col("sender_country"), spellings),
            "receiver_country": folded(F.col("receiver_country"), spellings),
        }
    )


def imputed(df: DataFrame, customers: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Missing sender countries from the customer file (receivers are left alone).

    Only the rows with a gap meet the customer file; the rest of the feed is not shuffled.
    """
    gap = F.col("sender_country").isNull()
    gaps = df.filter(gap)
    hot = find_hot(gaps, ("sender_account",), us=None) if hot is None else hot
    homes = customers.groupBy(F.col("account_id").alias("_account")).agg(
        F.min("home_country").alias("_home")
    )
    filled = (
        hot.lookup(gaps, "sender_account", homes, "_account")
        .withColumn("sender_country", F.col("_home"))
        .drop("_home")
    )
    return df.filter(~gap).unionByName(filled)


def without_exact_replays(df: DataFrame, counters: dict[str, Column] | None = None) -> DataFrame:
    """Identical rows collapse to one; NULLs count as equal."""
    counters = counters or {}
    return df.groupBy(*RAW_COLUMNS).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        *[F.sum(c.cast("bigint")).alias(name) for name, c in counters.items()],
    )


def without_near_replays(df: DataFrame) -> DataFrame:
    """One row per business key and minute, a time with seconds before one without.

    A time that could not be read counts as precise, as it has no zero second.
    Equally precise rows are settled by transaction id.
    """
    key = ["sender_account", "receiver_account", "amount", "transaction_type"]
    others = [c for c in RAW_COLUMNS if c not in key]
    precise = F.coalesce(F.second("timestamp") != 0, F.lit(True))
    best = F.min(F.struct((~precise).cast("int").alias("rank"), *others))
    sums = [c for c in df.columns if c not in RAW_COLUMNS]
    return (
        df.withColumn("_minute", F.date_trunc("minute", "timestamp"))
        .groupBy(*key, "_minute")
        .agg(
            best.alias("best"),
            F.count(F.lit(1)).alias("variants"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .select(*key, *[F.col(f"best.{c}") for c in others], "variants", *sums)
        .select(*RAW_COLUMNS, "variants", *sums)
    )


def traced(
    raw: DataFrame,
    customers: DataFrame,
    spellings: dict[str, str] | None = None,
    stray_types: dict[str, str] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """All surviving rows with their quarantine reason and the counts behind the log.

    The order of the steps matters: replays are compared on parsed times and folded
    names, and before stray transaction types are folded.
    """
    stray_types = {"wire_transfer": "transfer"} if stray_types is None else stray_types
    std = standardised(raw, spellings)
    std = std.withColumns(
        {
            "_unparsed": F.col("timestamp").isNull(),
            "_imputed": F.col("sender_country").isNull(),
            "_no_channel": F.col("channel").isNull(),
        }
    )
    filled = imputed(std, customers, hot).withColumn(
        "channel", F.coalesce("channel", F.lit("unknown"))
    )
    single = without_exact_replays(
        filled,
        {
            "raw_unparsed": F.col("_unparsed"),
            "raw_imputed": F.col("_imputed"),
            "raw_no_channel": F.col("_no_channel"),
        },
    )
    kept = without_near_replays(single.withColumn("_distinct", F.lit(1).cast("bigint")))
    stray = F.col("transaction_type").isin(*stray_types)
    return kept.withColumns(
        {
            "was_stray_type": stray.cast("int"),
            REASON: F.when(F.col("amount").isNull(), "amount_missing").when(
                F.col("amount") < 0, "amount_negative"
            ),
        }
    ).replace(stray_types, subset=["transaction_type"])


def clean_book(trace: DataFrame) -> DataFrame:
    return with_derived(trace.filter(F.col(REASON).isNull()).select(*RAW_COLUMNS))


def quarantine(trace: DataFrame) -> DataFrame:
    return trace.filter(F.col(REASON).isNotNull()).select(*RAW_COLUMNS, REASON)


def cleaning_log(trace: DataFrame) -> DataFrame:
    """One row of counts, from the traced rows alone."""
    kept = F.col(REASON).isNull()
    per_id = trace.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("variants").alias("variants"),
        *[F.sum(c).alias(c) for c in _COUNTERS],
        F.sum("was_stray_type").alias("stray"),
        F.count_if(F.col(REASON) == "amount_missing").alias("missing"),
        F.count_if(F.col(REASON) == "amount_negative").alias("negative"),
        F.count_if(kept & (F.col("amount") > LARGE_AMOUNT)).alias("large"),
        F.count_if(kept).alias("kept"),
    )
    total = {
        "rows_in": F.sum("raw_rows"),
        "unparsed_timestamps": F.sum("raw_unparsed"),
        "sender_country_imputed": F.sum("raw_imputed"),
        "channel_unknown": F.sum("raw_no_channel"),
        "exact_duplicates_dropped": F.sum("raw_rows") - F.sum("variants"),
        "near_duplicates_dropped": F.sum("variants") - F.sum("rows"),
        "ids_still_duplicated": F.sum(F.col("rows") - 1),
        "wire_transfer_type_remapped": F.sum("stray"),
        "quarantined_missing_amount": F.sum("missing"),
        "quarantined_negative_amount": F.sum("negative"),
        "amount_over_50k_kept": F.sum("large"),
        "rows_out": F.sum("kept"),
    }
    return per_id.agg(*[c.cast("bigint").alias(name) for name, c in total.items()])


def with_verdict(trace: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Traced rows with the part they go to, for one write split by it.

    ``unreadable`` are lines a scan could not read (``sources.scan.split``), with their reason.
    They are quarantined as they are: nothing is compared, imputed or folded in them.
    """
    rows = trace.withColumn(VERDICT, F.when(F.col(REASON).isNull(), KEPT).otherwise(REJECTED))
    if unreadable is None:
        return rows
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counts = {"raw_rows": one, "variants": one, "raw_unparsed": zero, "raw_imputed": zero}
    counts |= {"raw_no_channel": zero, "was_stray_type": F.lit(0)}
    lines = unreadable.select(*RAW_COLUMNS, REASON).withColumns(
        {
            "timestamp": parse_timestamp(F.col("timestamp")),
            **counts,
            VERDICT: F.lit(REJECTED),
        }
    )
    typed = [F.col(c).cast(t) for c, t in rows.dtypes if c in lines.columns]
    return rows.unionByName(lines.select(*typed), allowMissingColumns=True)


def log_metrics() -> dict[str, Column]:
    """What the log counts, as aggregates to be observed while the rows are written."""
    kept = F.col(REASON).isNull()

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return {
        "rows_in": total("raw_rows"),
        "unparsed_timestamps": total("raw_unparsed"),
        "sender_country_imputed": total("raw_imputed"),
        "channel_unknown": total("raw_no_channel"),
        "exact_duplicates_dropped": total("raw_rows") - total("variants"),
        "near_duplicates_dropped": total("variants") - F.count(F.lit(1)),
        "wire_transfer_type_remapped": total("was_stray_type"),
        "quarantined_missing_amount": F.count_if(F.col(REASON) == "amount_missing"),
        "quarantined_negative_amount": F.count_if(F.col(REASON) == "amount_negative"),
        "quarantined_unreadable": F.count_if(F.startswith(REASON, F.lit(_UNREADABLE))),
        "amount_over_50k_kept": F.count_if(kept & (F.col("amount") > LARGE_AMOUNT)),
        "rows_out": F.count_if(kept),
    }


def observed_log(metrics: DataFrame, written: DataFrame) -> DataFrame:
    """The log from observed metrics. Repeated ids are the one count that no pass over single
    rows can give: they take the id column of the written rows, and nothing else of them."""
    readable = ~F.coalesce(F.startswith(REASON, F.lit(_UNREADABLE)), F.lit(False))
    per_id = written.filter(readable).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n"))
    names = [*log_metrics()]
    return metrics.select(*names).withColumn("ids_still_duplicated", repeated.scalar())
