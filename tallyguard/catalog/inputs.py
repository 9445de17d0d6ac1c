"""Spark side inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, rules
from ..operators.cleaning import traced
from ..operators.evaluation import with_labels
from ..plans import find_hot, stage
from ..sources import testbook

# parameters that give non-trivial results on the supplied tables (FIXTURES.md)
PARAMS = {
    "structuring": {"band_low": 0.60},
    "rapid_movement": {"min_amount": 6_000},
    "high_risk_country": {"countries": testbook.HIGH_RISK},
}


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_clock(testbook.book(spark, sf_dir))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_all(book(spark, sf_dir), PARAMS)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traced(
        testbook.raw_book(spark, sf_dir), testbook.customers(spark, sf_dir), testbook.SPELLINGS
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule flags and labels."""
    return with_labels(flagged(spark, sf_dir), testbook.labels(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule flags, labels and the amount z-score as the score column, written once."""
    payments = book(spark, sf_dir)
    hot = find_hot(payments)
    flagged_rows = rules.apply_all(features.trailing_amounts(payments, hot), PARAMS, hot)
    rows = with_labels(flagged_rows, testbook.labels(spark, sf_dir))
    return stage(
        rows.withColumn("score", F.round("amount_z_vs_account", 6)).drop("amount_z_vs_account"),
        "scored",
    )
