"""Metrics, combination, ranks and the case list; the amount z-score serves as score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SWEEP
from ..operators import cases, cleaning, evaluation
from ..operators.evaluation import Ranking
from ..plans import stage
from ..sources import testbook
from .inputs import labelled, scored, trace
from .registry import query
from .tables_sql import CLEAN, FLAGGED, LABEL_FILE, SCORED, confusion_sql, with_tables

_RULES = ("structuring", "rapid_movement", "high_risk_country", "round_amount")
_A, _B = "structuring OR rapid_movement", "high_risk_country OR round_amount"


@query(
    "rule_metrics",
    with_tables(
        FLAGGED,
        confusion_sql("rule", {**{r: r for r in _RULES}, "any_rule": "rules_fired > 0"}, "flagged"),
    ),
)
def rule_metrics(spark, sf_dir):
    return evaluation.rule_metrics(labelled(spark, sf_dir))


@query(
    "tier_metrics",
    with_tables(FLAGGED, confusion_sql("tier", {"tier_a": _A, "tier_b": _B}, "flagged")),
)
def tier_metrics(spark, sf_dir):
    return evaluation.tier_metrics(labelled(spark, sf_dir))


@query(
    "rule_contribution",
    with_tables(
        FLAGGED,
        " UNION ALL ".join(
            f"""SELECT '{r}' AS rule, count(*) AS alerts, count(*) FILTER (label = 1) AS cases_caught,
  count(*) FILTER (rules_fired = 1) AS alerts_only_this_rule,
  count(*) FILTER (rules_fired = 1 AND label = 1) AS cases_no_other_rule_found,
  round(100.0 * count(*) FILTER (label = 1) / CAST(count(*) AS DOUBLE), 2) AS precision_pct
FROM flagged WHERE {r}"""
            for r in _RULES
        ),
    ),
)
def rule_contribution(spark, sf_dir):
    return evaluation.rule_contribution(labelled(spark, sf_dir))


@query(
    "rule_shares",
    with_tables(
        FLAGGED,
        " UNION ALL ".join(
            f"""SELECT '{name}' AS rule, count(*) FILTER ({flag}) AS alerts,
  round(count(*) FILTER ({flag}) / CAST(count(*) AS DOUBLE), 4) AS share_of_book FROM flagged"""
            for name, flag in {**{r: r for r in _RULES}, "rule_alert": "rules_fired > 0"}.items()
        ),
    ),
)
def rule_shares(spark, sf_dir):
    return evaluation.rule_shares(labelled(spark, sf_dir))


@query(
    "dataset_accounting",
    with_tables(
        f"{CLEAN}, {LABEL_FILE}, labels AS (SELECT transaction_id, max(is_laundering_pattern) AS label "
        "FROM label_file GROUP BY 1), joined AS (SELECT r.*, label FROM reasoned r "
        "LEFT JOIN labels USING (transaction_id))",
        """SELECT *, round(known_positives_surviving_cleaning / CAST(distinct_positive_transactions AS DOUBLE), 4)
    AS recall_ceiling
FROM (SELECT (SELECT count(*) FROM joined WHERE quarantine_reason IS NULL) AS clean_rows,
  (SELECT CAST(sum(is_laundering_pattern) AS BIGINT) FROM label_file) AS positive_rows_in_label_file,
  (SELECT CAST(sum(label) AS BIGINT) FROM labels) AS distinct_positive_transactions,
  (SELECT CAST(sum(label) AS BIGINT) FROM joined WHERE quarantine_reason IS NULL)
    AS known_positives_surviving_cleaning,
  (SELECT CAST(sum(label) AS BIGINT) FROM joined WHERE quarantine_reason IS NOT NULL)
    AS known_positives_lost_in_quarantine)""",
    ),
)
def dataset_accounting(spark, sf_dir):
    rows = stage(trace(spark, sf_dir), "traced")
    return evaluation.dataset_accounting(
        testbook.labels(spark, sf_dir), cleaning.clean_book(rows), cleaning.quarantine(rows)
    )


@query(
    "pct_rank",
    with_tables(SCORED, "SELECT transaction_id, score, round(pct, 9) AS anomaly_pct FROM ranked"),
)
def pct_rank(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return (
        Ranking(rows)
        .percentiles(rows)
        .select("transaction_id", "score", F.round("anomaly_pct", 9).alias("anomaly_pct"))
    )


@query(
    "calibration_sweep",
    with_tables(
        SCORED,
        "SELECT * EXCLUDE (threshold), CAST(threshold AS DOUBLE) AS tier_b_threshold_pct FROM ("
        + confusion_sql(
            "threshold", {str(t): f"tier_a OR (tier_b AND pct >= {t})" for t in SWEEP}, "ranked"
        )
        + ")",
    ),
)
def calibration_sweep(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return evaluation.calibration_sweep(rows, Ranking(rows))


_STRATEGIES = {
    "any_rule": "rules_fired > 0",
    "tier_a_only": "tier_a",
    "ml_only_channel": "ml_only",
    "combined_final": "final_alert",
    "ml_alone_same_budget": "score >= (SELECT min(score) FROM (SELECT score FROM final ORDER BY score DESC "
    "LIMIT (SELECT count(*) FROM final WHERE final_alert)))",
}


def _decided(spark, sf_dir):
    rows = scored(spark, sf_dir)
    ranking = Ranking(rows)
    return evaluation.combined(rows, ranking), ranking


@query("strategy_metrics", with_tables(SCORED, confusion_sql("strategy", _STRATEGIES, "final")))
def strategy_metrics(spark, sf_dir):
    return evaluation.strategy_metrics(*_decided(spark, sf_dir))


@query(
    "headline",
    with_tables(
        SCORED
        + ", m AS ("
        + confusion_sql(
            "strategy",
            {"base": "rules_fired > 0", "comb": "final_alert"},
            "final",
        )
        + ")",
        """SELECT b.alerts AS baseline_alerts, b.false_positives AS baseline_false_positives,
  b.recall AS baseline_recall, b.precision AS baseline_precision, c.alerts AS combined_alerts,
  c.false_positives AS combined_false_positives, c.recall AS combined_recall,
  c.precision AS combined_precision,
  round(100 * (b.alerts - c.alerts) / CAST(b.alerts AS DOUBLE), 1) AS alert_volume_reduction_pct,
  round(100 * (b.false_positives - c.false_positives) / CAST(b.false_positives AS DOUBLE), 1)
    AS false_positive_reduction_pct,
  CAST(round((b.alerts - c.alerts) * 0.25, 1) AS DOUBLE) AS analyst_hours_saved
FROM m b, m c WHERE b.strategy = 'base' AND c.strategy = 'comb'""",
    ),
)
def headline(spark, sf_dir):
    metrics = evaluation.strategy_metrics(*_decided(spark, sf_dir))
    return evaluation.headline(metrics, "any_rule", "combined_final")


@query(
    "combined_alerts",
    with_tables(
        SCORED,
        """SELECT transaction_id, CAST(tier_a AS INT) AS tier_a, CAST(corroborated AS INT) AS corroborated,
  CAST(ml_only AS INT) AS ml_only, escalation_channel FROM final WHERE final_alert""",
    ),
)
def combined_alerts(spark, sf_dir):
    decided, _ = _decided(spark, sf_dir)
    return decided.filter("final_alert").select(
        "transaction_id",
        *[F.col(c).cast("int").alias(c) for c in ("tier_a", "corroborated", "ml_only")],
        "escalation_channel",
    )


CASES_SQL = """
cases AS (
  SELECT *, round(pct, 4) AS anomaly_pct,
         CASE WHEN rule_reasons = '' THEN 'anomaly score only' ELSE rule_reasons END AS reason,
         CASE WHEN round(pct, 4) <= 0.90 THEN 'low' WHEN round(pct, 4) <= 0.99 THEN 'medium'
              ELSE 'high' END AS priority
  FROM final WHERE final_alert),
queue AS (
  SELECT *, row_number() OVER (ORDER BY anomaly_pct DESC, transaction_id) AS position FROM cases)"""


@query(
    "case_list",
    with_tables(
        f"{SCORED}, {CASES_SQL}",
        """SELECT printf('ALERT-%04d', position) AS alert_ref, strftime(t, '%Y-%m-%d %H:%M:%S') AS ts,
  sender_account, receiver_account, amount, sender_country, receiver_country, transaction_type,
  channel, reason, escalation_channel, anomaly_pct, priority FROM queue""",
    ),
)
def case_list(spark, sf_dir):
    rows = cases.case_list(cases.open_cases(*_decided(spark, sf_dir)))
    return rows.withColumn("ts", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop(
        "timestamp"
    )


@query(
    "case_counts",
    with_tables(
        f"{SCORED}, {CASES_SQL}",
        """SELECT 'channel' AS view, escalation_channel AS level, count(*) AS cases FROM cases GROUP BY 2
UNION ALL SELECT 'priority', priority, count(*) FROM cases GROUP BY 2""",
    ),
)
def case_counts(spark, sf_dir):
    return cases.case_counts(cases.open_cases(*_decided(spark, sf_dir)))


_GAIN = """
gain AS (
  SELECT DISTINCT score, count(*) OVER w AS alerts_reviewed,
         CAST(sum(label) OVER w AS BIGINT) AS cases_caught
  FROM scored WINDOW w AS (ORDER BY score DESC))"""


@query("gain_curve", with_tables(f"{SCORED}, {_GAIN}", "SELECT * FROM gain"))
def gain_curve(spark, sf_dir):
    return Ranking(scored(spark, sf_dir)).gain()


@query(
    "alerts_to_catch_all",
    with_tables(
        f"{SCORED}, {_GAIN}",
        """SELECT min(alerts_reviewed) AS alerts_to_catch_all, max(cases_caught) AS cases
FROM gain WHERE cases_caught = (SELECT max(cases_caught) FROM gain)""",
    ),
)
def alerts_to_catch_all(spark, sf_dir):
    return Ranking(scored(spark, sf_dir)).alerts_to_catch_all()


@query(
    "budget_recall",
    with_tables(
        SCORED,
        """SELECT 'amount z-score' AS detector, CAST(sum(label) AS BIGINT) AS cases_caught, of,
  round(sum(label) / CAST(of AS DOUBLE), 4) AS recall, round(sum(label) / 228.0, 4) AS precision
FROM (SELECT label, row_number() OVER (ORDER BY score DESC, transaction_id) AS rn,
             CAST(sum(label) OVER () AS BIGINT) AS of FROM scored)
WHERE rn <= 228 GROUP BY of""",
    ),
)
def budget_recall(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return evaluation.recall_at_budget(rows, Ranking(rows), 228, "amount z-score")
