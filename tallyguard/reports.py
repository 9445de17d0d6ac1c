"""Named SQL reports over registered views.

The rule operators run once: the book with its flags, exposure and label is written to the
shared folder, and every report is a plain select of that view. Only ``rule_contribution``
needs labels; the others run without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .operators import rules
from .operators.evaluation import distinct_labels
from .plans import HotKeys, find_hot, stage

_PAYMENT = "transaction_id, timestamp, sender_account, receiver_account, round(amount, 2) AS amount"
_RULES = ", ".join(f"'{r}', {r}" for r in C.RULES)

REPORTS = {
    "structuring": f"SELECT {_PAYMENT} FROM flagged WHERE structuring ORDER BY timestamp, transaction_id",
    "rapid_movement": f"SELECT {_PAYMENT} FROM flagged WHERE rapid_movement ORDER BY timestamp, transaction_id",
    "high_risk_country": """
        SELECT transaction_id, timestamp, sender_country, receiver_country,
               round(amount, 2) AS amount, exposure
        FROM flagged WHERE high_risk_country ORDER BY timestamp, transaction_id""",
    "rule_contribution": f"""
        SELECT rule,
               count_if(hit) AS alerts,
               count_if(hit AND is_case) AS cases_caught,
               round(100 * count_if(hit AND is_case) / count_if(hit), 2) AS precision_pct,
               count_if(hit AND rules_fired = 1) AS alerts_only_this_rule,
               count_if(hit AND is_case AND rules_fired = 1) AS cases_no_other_rule_found
        FROM labelled LATERAL VIEW stack({len(C.RULES)}, {_RULES}) AS rule, hit
        GROUP BY rule HAVING count_if(hit) > 0
        ORDER BY alerts DESC, rule""",
}


def register(
    spark: SparkSession,
    book: DataFrame,
    customers: DataFrame,
    labels: DataFrame | None = None,
    params: dict[str, dict] | None = None,
    hot: HotKeys | None = None,
) -> None:
    """Create the views the reports read; labels are reduced to one row per id."""
    params = params or {}
    book = rules.with_clock(book)
    hot = find_hot(book) if hot is None else hot
    listed = params.get("high_risk_country", {}).get("countries", C.HIGH_RISK_COUNTRIES)
    exposure = F.when(F.col("high_risk_country"), rules.exposure(listed))
    flagged = stage(rules.apply_all(book, params, hot).withColumn("exposure", exposure), "reports")
    customers.createOrReplaceTempView("customers")
    flagged.createOrReplaceTempView("flagged")
    if labels is None:
        spark.catalog.dropTempView("labelled")
    else:
        marks = distinct_labels(labels).select("transaction_id", F.col("label").alias("_label"))
        is_case = F.coalesce(F.col("_label") == 1, F.lit(False)).alias("is_case")
        flagged.join(marks, "transaction_id", "left").select(
            "transaction_id", *C.RULES, "rules_fired", is_case
        ).createOrReplaceTempView("labelled")


def run(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(REPORTS[name])


def run_all(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: run(spark, name) for name in sorted(REPORTS)}


# Reports with thresholds: SQL table functions over the views, (arguments, columns, body)
FUNCTIONS = {
    "payments_in_band": (
        "threshold DOUBLE, low DOUBLE, times BIGINT",
        "sender_account STRING, payments BIGINT, pennies BIGINT, flagged BIGINT",
        """SELECT sender_account, count(*) AS payments,
                  sum(CAST(round(amount * 100) AS BIGINT)) AS pennies, count_if(structuring) AS flagged
           FROM flagged
           WHERE amount >= payments_in_band.threshold * payments_in_band.low
             AND amount < payments_in_band.threshold AND sender_account IS NOT NULL
           GROUP BY sender_account HAVING count(*) >= max(payments_in_band.times)""",
    ),
    "country_exposure": (
        "countries ARRAY<STRING>, at_least DOUBLE",
        "transaction_id STRING, amount DOUBLE, sender_listed BOOLEAN, receiver_listed BOOLEAN",
        """SELECT transaction_id, round(amount, 2), sender_listed, receiver_listed FROM (
             SELECT *, coalesce(array_contains(country_exposure.countries, sender_country), false) AS sender_listed,
                    coalesce(array_contains(country_exposure.countries, receiver_country), false) AS receiver_listed
             FROM flagged WHERE amount >= country_exposure.at_least)
           WHERE sender_listed OR receiver_listed""",
    ),
    "rule_overlap": (
        "at_least DOUBLE, rules_at_least INT",
        "reason STRING, alerts BIGINT, pennies BIGINT",
        """SELECT rule_reasons, count(*), sum(CAST(round(amount * 100) AS BIGINT)) FROM flagged
           WHERE amount >= rule_overlap.at_least AND rules_fired >= rule_overlap.rules_at_least
           GROUP BY rule_reasons""",
    ),
}


def define(spark: SparkSession) -> None:
    """Make the parametrised reports callable from SQL text of one's own (after ``register``)."""
    for name, (arguments, columns, body) in FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) "
            f"RETURNS TABLE ({columns}) RETURN {body}"
        )


def call(spark: SparkSession, name: str, **arguments) -> DataFrame:
    """A parametrised report. Values are bound as named markers, never pasted into the text."""
    marks = ", ".join(f"{a} => :{a}" for a in arguments)
    return spark.sql(f"SELECT * FROM {name}({marks})", args=arguments)
