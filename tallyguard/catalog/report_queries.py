"""The named SQL reports, and books with defects the supplied tables do not contain."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import reports
from ..operators import evaluation, features, rules
from ..operators.rules import with_row_key
from ..plans import stage
from ..sources import testbook
from .inputs import PARAMS, book
from .registry import query
from .tables_sql import BOOK, FLAGGED, HIGH_RISK_SQL, with_tables

_RULES = ("structuring", "rapid_movement", "high_risk_country", "round_amount")


def _report(spark, sf_dir, name):
    labels = testbook.labels(spark, sf_dir)
    reports.register(spark, book(spark, sf_dir), testbook.customers(spark, sf_dir), labels, PARAMS)
    # staged, since another registration replaces the views this one reads
    return stage(reports.run(spark, name), f"report-{name}")


def _payments(spark, sf_dir, name):
    return _report(spark, sf_dir, name).withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


def _payment_sql(rule: str) -> str:
    body = f"SELECT transaction_id, us, sender_account, receiver_account, amount FROM flagged WHERE {rule}"
    return with_tables(FLAGGED, body)


@query("report_structuring", _payment_sql("structuring"))
def report_structuring(spark, sf_dir):
    return _payments(spark, sf_dir, "structuring")


@query("report_rapid_movement", _payment_sql("rapid_movement"))
def report_rapid_movement(spark, sf_dir):
    return _payments(spark, sf_dir, "rapid_movement")


@query(
    "report_high_risk_country",
    with_tables(
        BOOK,
        f"""SELECT transaction_id, us, sender_country, receiver_country, amount,
  concat(CASE WHEN s AND r THEN 'both legs' WHEN s THEN 'sender' ELSE 'receiver' END) AS exposure
FROM (SELECT *, coalesce(sender_country IN {HIGH_RISK_SQL}, false) AS s,
        coalesce(receiver_country IN {HIGH_RISK_SQL}, false) AS r FROM book) WHERE s OR r""",
    ),
)
def report_high_risk_country(spark, sf_dir):
    return _payments(spark, sf_dir, "high_risk_country")


@query(
    "report_rule_contribution",
    with_tables(
        FLAGGED,
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{r}' AS rule, count(*) AS alerts, sum(label) AS cases_caught,
  round(100.0 * sum(label) / count(*), 2) AS precision_pct,
  count(*) FILTER (rules_fired = 1) AS alerts_only_this_rule,
  coalesce(sum(label) FILTER (rules_fired = 1), 0) AS cases_no_other_rule_found
FROM flagged WHERE {r}"""
            for r in _RULES
        )
        + ") WHERE alerts > 0",
    ),
)
def report_rule_contribution(spark, sf_dir):
    return _report(spark, sf_dir, "rule_contribution")


@query(
    "features_unknown_accounts",
    with_tables(
        BOOK,
        """SELECT transaction_id, known,
  CASE WHEN known THEN n ELSE 0 END AS sender_txn_count,
  CASE WHEN known THEN day_n ELSE 0 END AS sender_velocity_24h
FROM (
  SELECT transaction_id, us % 7 <> 0 AS known,
    count(*) OVER (PARTITION BY k ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
    (SELECT count(*) FROM book o WHERE o.us % 7 <> 0 AND o.sender_account = b.sender_account
       AND o.us >= b.us - 86400000000 AND (o.us, o.transaction_id) < (b.us, b.transaction_id)) AS day_n
  FROM (SELECT *, CASE WHEN us % 7 <> 0 THEN sender_account END AS k FROM book) b)""",
    ),
)
def features_unknown_accounts(spark, sf_dir):
    """A seventh of the payments has no sender: these have no past, and are nobody's past."""
    known = F.col("us") % 7 != 0
    rows = book(spark, sf_dir).withColumn("sender_account", F.when(known, F.col("sender_account")))
    past = features.history(
        rows, "sender", features.find_hot(rows), {"sender_velocity_24h": 24}, "sender_txn_count"
    )
    return past.select(
        "transaction_id", known.alias("known"), "sender_txn_count", "sender_velocity_24h"
    )


@query(
    "rules_repeated_ids",
    with_tables(
        BOOK,
        f"""SELECT id AS transaction_id, us, round(amount, 2) AS score,
  amount = floor(amount) AND amount >= 1000 AS round_amount,
  coalesce(sender_country IN {HIGH_RISK_SQL}, false) OR coalesce(receiver_country IN {HIGH_RISK_SQL}, false)
    AS high_risk_country
FROM (SELECT *, left(transaction_id, length(transaction_id) - 1) AS id FROM book)""",
    ),
)
def rules_repeated_ids(spark, sf_dir):
    """Ten payments share each id: flags and scores still meet row by row."""
    shorter = F.expr("left(transaction_id, length(transaction_id) - 1)")
    rows = with_row_key(book(spark, sf_dir).withColumn("transaction_id", shorter))
    flagged = rules.apply_all(rows, PARAMS)
    scores = rows.select("row_key", F.round("amount", 2).alias("score"))
    return evaluation.with_scores(flagged, scores).select(
        "transaction_id", "us", "score", "round_amount", "high_risk_country"
    )


def _call(spark, sf_dir, name, **arguments):
    reports.register(spark, book(spark, sf_dir), testbook.customers(spark, sf_dir), params=PARAMS)
    reports.define(spark)
    return stage(reports.call(spark, name, **arguments), f"report-{name}")


for _name, _threshold, _low, _times in (
    ("report_band_wide", 10_000.0, 0.6, 2),
    ("report_band_narrow", 8_000.0, 0.9, 1),
):

    @query(
        _name,
        with_tables(
            FLAGGED,
            f"""SELECT sender_account, count(*) AS payments, CAST(sum(cents) AS BIGINT) AS pennies,
  count(*) FILTER (structuring) AS flagged FROM flagged
WHERE amount >= CAST({_threshold} AS DOUBLE) * CAST({_low} AS DOUBLE) AND amount < {_threshold} GROUP BY 1 HAVING count(*) >= {_times}""",
        ),
    )
    def report_band(spark, sf_dir, threshold=_threshold, low=_low, times=_times):
        """The same SQL table function at two settings."""
        return _call(spark, sf_dir, "payments_in_band", threshold=threshold, low=low, times=times)


for _name, _countries, _floor in (
    ("report_exposure_listed", testbook.HIGH_RISK, 0.0),
    ("report_exposure_large", ("NATION_1", "NATION_2"), 5_000.0),
):

    @query(
        _name,
        with_tables(
            BOOK,
            f"""SELECT * FROM (SELECT transaction_id, round(amount, 2) AS amount,
  coalesce(sender_country IN {_countries}, false) AS sender_listed,
  coalesce(receiver_country IN {_countries}, false) AS receiver_listed FROM book WHERE amount >= {_floor})
WHERE sender_listed OR receiver_listed""",
        ),
    )
    def report_exposure(spark, sf_dir, countries=_countries, floor=_floor):
        return _call(
            spark, sf_dir, "country_exposure", countries=F.array(*map(F.lit, countries)), at_least=floor
        )


for _name, _floor, _rules in (("report_overlap_any", 0.0, 1), ("report_overlap_double", 1_000.0, 2)):

    @query(
        _name,
        with_tables(
            FLAGGED,
            f"""SELECT rule_reasons AS reason, count(*) AS alerts, CAST(sum(cents) AS BIGINT) AS pennies
FROM flagged WHERE amount >= {_floor} AND rules_fired >= {_rules} GROUP BY 1""",
        ),
    )
    def report_overlap(spark, sf_dir, floor=_floor, fired=_rules):
        return _call(spark, sf_dir, "rule_overlap", at_least=floor, rules_at_least=fired)
