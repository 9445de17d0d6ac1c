"""The analyst queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import priority
from ..functions.text import reference
from ..plans import numbered
from .evaluation import Ranking

CASE_COLUMNS = (
    "alert_ref",
    "timestamp",
    "sender_account",
    "receiver_account",
    "amount",
    "sender_country",
    "receiver_country",
    "transaction_type",
    "channel",
    "reason",
    "escalation_channel",
    "anomaly_pct",
    "priority",
)


def open_cases(decided: DataFrame, ranking: Ranking) -> DataFrame:
    """Final alerts with reason, percentile and priority, still under their own id."""
    alerts = ranking.percentiles(decided.filter("final_alert"))
    return alerts.withColumns(
        {
            "anomaly_pct": F.round("anomaly_pct", 4),
            "reason": F.when(F.col("rule_reasons") == "", "anomaly score only").otherwise(
                F.col("rule_reasons")
            ),
        }
    ).withColumn("priority", priority(F.col("anomaly_pct")))


def queue(cases: DataFrame) -> DataFrame:
    """Numbered from the most urgent; ids give way to neutral references when published.

    Priority is a function of the percentile, so one key orders both.
    """
    return numbered(cases, [F.desc("anomaly_pct"), F.asc("transaction_id")]).withColumn(
        "alert_ref", reference(F.col("position"))
    )


def case_list(cases: DataFrame) -> DataFrame:
    return queue(cases).select(*CASE_COLUMNS)


def case_counts(cases: DataFrame) -> DataFrame:
    """Cases per escalation channel and per priority."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("channel").alias("view"), F.col("escalation_channel").alias("level")),
            F.struct(F.lit("priority").alias("view"), F.col("priority").alias("level")),
        )
    )
    return (
        cases.select(pairs.alias("p"))
        .groupBy("p.view", "p.level")
        .agg(F.count(F.lit(1)).alias("cases"))
    )
