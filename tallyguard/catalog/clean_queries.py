"""Cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning
from ..sources import testbook
from .inputs import trace
from .registry import query
from .tables_sql import CLEAN, with_tables

_ROW = (
    "transaction_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, sender_account, receiver_account, "
    "amount, currency, sender_country, receiver_country, transaction_type, channel"
)


def _row():
    return [
        "transaction_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "sender_account",
        "receiver_account",
        "amount",
        "currency",
        "sender_country",
        "receiver_country",
        "transaction_type",
        "channel",
    ]


@query(
    "clean_book",
    with_tables(
        CLEAN,
        f"""SELECT {_ROW}, CAST(sender_country <> receiver_country AS INT) AS is_cross_border,
  CAST(hour(t) AS INT) AS hour, CAST(isodow(t) - 1 AS INT) AS day_of_week,
  strftime(t, '%Y-%m-%d') AS day
FROM reasoned WHERE quarantine_reason IS NULL""",
    ),
)
def clean_book(spark, sf_dir):
    clean = cleaning.clean_book(trace(spark, sf_dir))
    return clean.select(
        *_row(),
        "is_cross_border",
        "hour",
        "day_of_week",
        F.date_format("date", "yyyy-MM-dd").alias("day"),
    )


@query(
    "quarantine",
    with_tables(
        CLEAN,
        f"SELECT {_ROW}, quarantine_reason FROM reasoned WHERE quarantine_reason IS NOT NULL",
    ),
)
def quarantine(spark, sf_dir):
    return cleaning.quarantine(trace(spark, sf_dir)).select(*_row(), "quarantine_reason")


@query(
    "dedup_replays",
    with_tables(
        CLEAN,
        """SELECT (SELECT count(*) FROM filled) AS rows_in, (SELECT count(*) FROM single) AS after_exact,
  (SELECT count(*) FROM deduped) AS after_near""",
    ),
)
def dedup_replays(spark, sf_dir):
    return trace(spark, sf_dir).agg(
        F.sum("raw_rows").alias("rows_in"),
        F.sum("variants").alias("after_exact"),
        F.count(F.lit(1)).alias("after_near"),
    )


@query(
    "timestamp_parse",
    with_tables(
        CLEAN,
        """SELECT transaction_id, ts_text, strftime(CASE WHEN contains(ts_text, '/')
    THEN try_strptime(ts_text, '%d/%m/%Y %H:%M') ELSE try_strptime(ts_text, '%Y-%m-%d %H:%M:%S') END,
    '%Y-%m-%d %H:%M:%S') AS ts FROM raw_book""",
    ),
)
def timestamp_parse(spark, sf_dir):
    raw = testbook.raw_book(spark, sf_dir)
    return raw.select(
        "transaction_id",
        F.col("timestamp").alias("ts_text"),
        F.date_format(
            cleaning.parse_timestamp(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss"
        ).alias("ts"),
    )


@query(
    "country_fold",
    with_tables(
        CLEAN,
        """SELECT sender_known AS sender_country, receiver_country, count(*) AS n
FROM typed GROUP BY ALL""",
    ),
)
def country_fold(spark, sf_dir):
    std = cleaning.standardised(testbook.raw_book(spark, sf_dir), testbook.SPELLINGS)
    return std.groupBy("sender_country", "receiver_country").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sender_country_imputed",
    with_tables(
        CLEAN,
        """SELECT transaction_id, sender_account, sender_country, count(*) AS n
FROM filled JOIN (SELECT DISTINCT transaction_id FROM typed WHERE sender_known IS NULL)
USING (transaction_id) GROUP BY ALL""",
    ),
)
def sender_country_imputed(spark, sf_dir):
    std = cleaning.standardised(testbook.raw_book(spark, sf_dir), testbook.SPELLINGS)
    gaps = std.filter(F.col("sender_country").isNull())
    return (
        cleaning.imputed(gaps, testbook.customers(spark, sf_dir))
        .groupBy("transaction_id", "sender_account", "sender_country")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "cleaning_log",
    with_tables(
        CLEAN,
        """SELECT (SELECT count(*) FROM typed) AS rows_in,
  (SELECT count(*) FROM typed WHERE t IS NULL) AS unparsed_timestamps,
  (SELECT count(*) FROM typed WHERE sender_known IS NULL) AS sender_country_imputed,
  (SELECT count(*) FROM typed WHERE channel_known IS NULL) AS channel_unknown,
  (SELECT count(*) FROM filled) - (SELECT count(*) FROM single) AS exact_duplicates_dropped,
  (SELECT count(*) FROM single) - count(*) AS near_duplicates_dropped,
  count(*) - count(DISTINCT transaction_id) AS ids_still_duplicated,
  count(*) FILTER (was_stray) AS wire_transfer_type_remapped,
  count(*) FILTER (quarantine_reason = 'amount_missing') AS quarantined_missing_amount,
  count(*) FILTER (quarantine_reason = 'amount_negative') AS quarantined_negative_amount,
  count(*) FILTER (quarantine_reason IS NULL AND amount > 50000) AS amount_over_50k_kept,
  count(*) FILTER (quarantine_reason IS NULL) AS rows_out
FROM reasoned""",
    ),
)
def cleaning_log(spark, sf_dir):
    return cleaning.cleaning_log(trace(spark, sf_dir))
