"""Detection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..sources import testbook
from .inputs import PARAMS, book, flagged
from .registry import query
from .tables_sql import BOOK, FLAGGED, HIGH_RISK_SQL, rapid_sql, structuring_sql, with_tables


@query(
    "structuring_flags",
    with_tables(
        f"{BOOK}, {structuring_sql()}",
        "SELECT transaction_id, us, sender_account, receiver_account, amount "
        "FROM book SEMI JOIN structuring USING (transaction_id)",
    ),
)
def structuring_flags(spark, sf_dir):
    payments = book(spark, sf_dir)
    ids = rules.structuring(payments, **PARAMS["structuring"])
    return payments.join(ids, "transaction_id", "left_semi").select(
        "transaction_id", "us", "sender_account", "receiver_account", "amount"
    )


@query(
    "structuring_flags_default_band",
    with_tables(f"{BOOK}, {structuring_sql(0.70)}", "SELECT transaction_id FROM structuring"),
)
def structuring_flags_default_band(spark, sf_dir):
    return rules.structuring(book(spark, sf_dir))


@query(
    "rapid_movement_flags",
    with_tables(
        f"{BOOK}, {rapid_sql()}",
        "SELECT transaction_id, us, sender_account, receiver_account, amount "
        "FROM book SEMI JOIN rapid USING (transaction_id)",
    ),
)
def rapid_movement_flags(spark, sf_dir):
    payments = book(spark, sf_dir)
    ids = rules.rapid_movement(payments, **PARAMS["rapid_movement"])
    return payments.join(ids, "transaction_id", "left_semi").select(
        "transaction_id", "us", "sender_account", "receiver_account", "amount"
    )


@query(
    "rapid_movement_flags_default_floor",
    with_tables(f"{BOOK}, {rapid_sql(1000)}", "SELECT transaction_id FROM rapid"),
)
def rapid_movement_flags_default_floor(spark, sf_dir):
    return rules.rapid_movement(book(spark, sf_dir))


@query(
    "high_risk_exposure",
    with_tables(
        BOOK,
        f"""SELECT transaction_id, us, sender_country, receiver_country, amount,
  CASE WHEN sender_country IN {HIGH_RISK_SQL} AND receiver_country IN {HIGH_RISK_SQL} THEN 'both legs'
       WHEN sender_country IN {HIGH_RISK_SQL} THEN 'sender' ELSE 'receiver' END AS exposure
FROM book WHERE sender_country IN {HIGH_RISK_SQL} OR receiver_country IN {HIGH_RISK_SQL}""",
    ),
)
def high_risk_exposure(spark, sf_dir):
    return (
        book(spark, sf_dir)
        .filter(rules.is_high_risk(testbook.HIGH_RISK))
        .select(
            "transaction_id",
            "us",
            "sender_country",
            "receiver_country",
            "amount",
            rules.exposure(testbook.HIGH_RISK).alias("exposure"),
        )
    )


@query(
    "round_amount_flags",
    with_tables(
        BOOK,
        "SELECT transaction_id, amount FROM book WHERE amount = floor(amount) AND amount >= 1000",
    ),
)
def round_amount_flags(spark, sf_dir):
    return book(spark, sf_dir).filter(rules.is_round()).select("transaction_id", "amount")


@query(
    "rules_applied",
    with_tables(
        FLAGGED,
        """SELECT transaction_id, CAST(structuring AS INT) AS structuring,
  CAST(rapid_movement AS INT) AS rapid_movement, CAST(high_risk_country AS INT) AS high_risk_country,
  CAST(round_amount AS INT) AS round_amount, rules_fired, CAST(rules_fired > 0 AS INT) AS rule_alert,
  rule_reasons FROM flagged""",
    ),
)
def rules_applied(spark, sf_dir):
    return flagged(spark, sf_dir).select(
        "transaction_id",
        *[F.col(r).cast("int").alias(r) for r in rules.RULES],
        "rules_fired",
        F.col("rule_alert").cast("int").alias("rule_alert"),
        "rule_reasons",
    )


@query(
    "rules_fired_long",
    with_tables(
        FLAGGED,
        """SELECT transaction_id, rule, rules_fired FROM (
  SELECT transaction_id, rules_fired, unnest(string_split(rule_reasons, ', ')) AS rule
  FROM flagged WHERE rules_fired > 0)""",
    ),
)
def rules_fired_long(spark, sf_dir):
    return rules.fired_long(flagged(spark, sf_dir))
