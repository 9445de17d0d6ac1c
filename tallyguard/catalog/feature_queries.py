"""Trailing features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from ..plans import find_hot
from ..sources import testbook
from .inputs import book
from .registry import query
from .tables_sql import BOOK, CUSTOMERS, PAST, with_tables

_BEFORE = (
    "b.{k}_account = a.{k}_account AND (b.us < a.us OR (b.us = a.us AND b.transaction_id < a.transaction_id))"
)
_SENT, _GOT = _BEFORE.format(k="sender"), _BEFORE.format(k="receiver")

VELOCITY = f"""
sent AS (
  SELECT a.transaction_id, count(b.transaction_id) AS sender_txn_count,
         count(*) FILTER (b.us >= a.us - 86400000000) AS sender_velocity_24h,
         count(*) FILTER (b.us >= a.us - 604800000000) AS sender_velocity_7d,
         count(DISTINCT b.receiver_account) AS sender_distinct_counterparties
  FROM book a LEFT JOIN book b ON {_SENT} GROUP BY a.transaction_id),
got AS (
  SELECT a.transaction_id, count(*) FILTER (b.us >= a.us - 86400000000) AS receiver_velocity_24h,
         count(DISTINCT b.sender_account) AS receiver_distinct_counterparties
  FROM book a LEFT JOIN book b ON {_GOT} GROUP BY a.transaction_id)"""

TENURE = """
aged AS (
  SELECT transaction_id, date_diff('day', account_open_date, CAST(t AS DATE)) AS days
  FROM book LEFT JOIN customers ON account_id = sender_account),
tenure AS (
  SELECT transaction_id, CAST(coalesce(days, (SELECT median(days) FROM aged)) AS DOUBLE)
         AS sender_account_age_days FROM aged)"""

_TYPES = ("click", "error", "purchase", "transfer", "view")
_CHANNELS = ("atm_withdrawal", "card_payment", "mobile_app", "online_transfer", "wire_transfer")


@query(
    "velocity_features",
    with_tables(
        f"{BOOK}, {VELOCITY}",
        """SELECT transaction_id, sender_velocity_24h, sender_velocity_7d, sender_txn_count,
  receiver_velocity_24h FROM sent JOIN got USING (transaction_id)""",
    ),
)
def velocity_features(spark, sf_dir):
    payments = book(spark, sf_dir).select(
        "transaction_id", "us", "sender_account", "receiver_account", "amount"
    )
    hot = find_hot(payments)
    sent = features.history(
        payments,
        "sender",
        hot,
        {"sender_velocity_24h": 24, "sender_velocity_7d": 168},
        count="sender_txn_count",
    )
    return features.history(sent, "receiver", hot, {"receiver_velocity_24h": 24}).select(
        "transaction_id",
        "sender_velocity_24h",
        "sender_velocity_7d",
        "sender_txn_count",
        "receiver_velocity_24h",
    )


@query(
    "trailing_counterparties",
    with_tables(
        f"{BOOK}, {VELOCITY}",
        """SELECT transaction_id, sender_distinct_counterparties, receiver_distinct_counterparties
FROM sent JOIN got USING (transaction_id)""",
    ),
)
def trailing_counterparties(spark, sf_dir):
    payments = book(spark, sf_dir).select(
        "transaction_id", "us", "sender_account", "receiver_account", "amount"
    )
    hot = find_hot(payments)
    sent = features.history(payments, "sender", hot, distinct="sender_distinct_counterparties")
    return features.history(
        sent, "receiver", hot, distinct="receiver_distinct_counterparties"
    ).select(
        "transaction_id", "sender_distinct_counterparties", "receiver_distinct_counterparties"
    )


@query(
    "trailing_amount_stats",
    with_tables(
        f"{BOOK}, {PAST}",
        """SELECT transaction_id, CAST(past_n AS BIGINT) AS past_count, z AS amount_z_vs_account,
  vs_max AS amount_vs_account_max FROM scored_z""",
    ),
)
def trailing_amount_stats(spark, sf_dir):
    return features.trailing_amounts(book(spark, sf_dir)).select(
        "transaction_id",
        "past_count",
        F.round("amount_z_vs_account", 6).alias("amount_z_vs_account"),
        F.round("amount_vs_account_max", 6).alias("amount_vs_account_max"),
    )


@query(
    "tenure_features",
    with_tables(
        f"{BOOK}, {CUSTOMERS}, {TENURE}",
        "SELECT transaction_id, sender_account_age_days FROM tenure",
    ),
)
def tenure_features(spark, sf_dir):
    return features.with_tenure(book(spark, sf_dir), testbook.customers(spark, sf_dir)).select(
        "transaction_id", "sender_account_age_days"
    )


_HOT = ", ".join(
    [f"CAST(transaction_type = '{v}' AS DOUBLE) AS transaction_type_{v}" for v in _TYPES]
    + [f"CAST(channel = '{v}' AS DOUBLE) AS channel_{v}" for v in _CHANNELS]
)


@query(
    "feature_matrix",
    with_tables(
        f"{BOOK}, {CUSTOMERS}, {VELOCITY}, {TENURE}, {PAST}",
        f"""SELECT transaction_id, round(ln(1 + amount), 6) AS log_amount, z AS amount_z_vs_account,
  vs_max AS amount_vs_account_max, CAST(hour AS DOUBLE) AS hour,
  CAST(hour BETWEEN 1 AND 5 AS DOUBLE) AS is_night, CAST(day_of_week AS DOUBLE) AS day_of_week,
  CAST(day_of_week >= 5 AS DOUBLE) AS is_weekend, CAST(is_cross_border AS DOUBLE) AS is_cross_border,
  CAST(sender_velocity_24h AS DOUBLE) AS sender_velocity_24h,
  CAST(sender_velocity_7d AS DOUBLE) AS sender_velocity_7d,
  CAST(receiver_velocity_24h AS DOUBLE) AS receiver_velocity_24h,
  CAST(sender_txn_count AS DOUBLE) AS sender_txn_count,
  CAST(sender_distinct_counterparties AS DOUBLE) AS sender_distinct_counterparties,
  CAST(receiver_distinct_counterparties AS DOUBLE) AS receiver_distinct_counterparties,
  sender_account_age_days, round(amount / 10000, 6) AS pct_of_threshold, {_HOT}
FROM book JOIN sent USING (transaction_id) JOIN got USING (transaction_id)
  JOIN tenure USING (transaction_id) JOIN scored_z USING (transaction_id)""",
    ),
)
def feature_matrix(spark, sf_dir):
    payments = book(spark, sf_dir)
    levels = features.observed_levels(payments)
    matrix = features.build_features(payments, testbook.customers(spark, sf_dir), levels)
    return matrix.select(
        "transaction_id", *[F.round(c, 6).alias(c) for c in features.feature_names(levels)]
    )
