"""Sinks: tables, reports and payloads as they are written, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workflow
from ..operators import cases, cleaning, evaluation, evidence, profiling, sketch
from ..operators.evaluation import Ranking
from ..plans import stage
from ..plans.stage import new_folder
from ..sources import files, sinks, testbook
from .evaluation_queries import CASES_SQL
from .inputs import labelled, scored, trace
from .registry import ORACLE, query
from .tables_sql import RAW, SCORED, with_tables


def _time():
    return F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")


def _published_trace(spark, sf_dir):
    path = new_folder(spark, "published")
    rows = cleaning.with_verdict(trace(spark, sf_dir))
    sinks.publish(rows, path, "r1", by=(cleaning.VERDICT,), metrics=cleaning.log_metrics())
    # a second driver with the same run finds it published and writes nothing
    sinks.publish(rows.limit(0), path, "r1", by=(cleaning.VERDICT,))
    return path


@query("quarantine_published", ORACLE["quarantine"])
def quarantine_published(spark, sf_dir):
    """K2: the quarantine is one subfolder of the write that the clean book comes from."""
    rows = sinks.read_published(spark, _published_trace(spark, sf_dir), "r1")
    rejected = cleaning.quarantine(rows.filter(F.col(cleaning.VERDICT) == cleaning.REJECTED))
    return rejected.withColumn("ts", _time()).drop("timestamp")


@query("clean_book_published", ORACLE["clean_book"])
def clean_book_published(spark, sf_dir):
    rows = sinks.read_published(spark, _published_trace(spark, sf_dir), "r1")
    kept = cleaning.clean_book(rows.filter(F.col(cleaning.VERDICT) == cleaning.KEPT))
    return kept.withColumns({"ts": _time(), "day": F.date_format("date", "yyyy-MM-dd")}).drop(
        "timestamp", "date"
    )


@query("cleaning_log_observed", ORACLE["cleaning_log"])
def cleaning_log_observed(spark, sf_dir):
    """A17, C10: counted while the rows are written, not by a pass of its own."""
    path = _published_trace(spark, sf_dir)
    metrics = sinks.observed_metrics(spark, path, "r1")
    log = cleaning.observed_log(metrics, sinks.read_published(spark, path, "r1"))
    return log.drop("quarantined_unreadable")


def _decided(spark, sf_dir):
    rows = scored(spark, sf_dir)
    ranking = Ranking(rows)
    return evaluation.combined(rows, ranking), ranking


@query(
    "scored_book",
    with_tables(
        SCORED,
        """SELECT transaction_id, sender_account, receiver_account, amount, score, label, rules_fired,
  CAST(final_alert AS INT) AS final_alert, escalation_channel FROM final""",
    ),
)
def scored_book(spark, sf_dir):
    """K1: the scored book, split by what became an alert."""
    decided, _ = _decided(spark, sf_dir)
    path = new_folder(spark, "scored-book")
    sinks.publish(decided, path, "r1", by=("final_alert",))
    return sinks.read_published(spark, path).select(
        "transaction_id",
        "sender_account",
        "receiver_account",
        "amount",
        "score",
        "label",
        "rules_fired",
        F.col("final_alert").cast("int").alias("final_alert"),
        "escalation_channel",
    )


_SHOWN = "alerts, true_positives, false_positives, recall, precision"


@query(
    "metrics_report",
    f"""SELECT 'rules' AS section, rule AS name, {_SHOWN} FROM ({ORACLE["rule_metrics"]})
UNION ALL SELECT 'strategies', strategy, {_SHOWN} FROM ({ORACLE["strategy_metrics"]})
UNION ALL SELECT 'sweep', CAST(tier_b_threshold_pct AS VARCHAR), {_SHOWN} FROM ({ORACLE["calibration_sweep"]})""",
)
def metrics_report(spark, sf_dir):
    """K3: one nested report, written as JSON and read back table by table."""
    decided, ranking = _decided(spark, sf_dir)
    decided = stage(decided, "decided")
    report = workflow.metrics_report(
        spark,
        {
            "rules": evaluation.rule_metrics(labelled(spark, sf_dir)),
            "strategies": evaluation.strategy_metrics(decided, ranking),
            "sweep": evaluation.calibration_sweep(decided, ranking),
        },
    )
    path = new_folder(spark, "report")
    files.write_json(report, path)
    read = spark.read.schema(report.schema).json(path)
    shown = _SHOWN.split(", ")
    names = {"rules": "rule", "strategies": "strategy", "sweep": "tier_b_threshold_pct"}
    parts = [
        read.select(F.inline(section)).select(
            F.lit(section).alias("section"), F.col(key).cast("string").alias("name"), *shown
        )
        for section, key in names.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PAGE = 100


@query(
    "payload_document",
    with_tables(
        f"{SCORED}, {CASES_SQL}",
        f"""SELECT (position - 1) // {_PAGE} AS page, printf('ALERT-%04d', position) AS id,
  round(amount, 2) AS amount, replace(reason, ', ', '|') AS reasons, priority,
  (SELECT count(*) FROM final WHERE final_alert) AS n_cases,
  (SELECT count(*) FROM final WHERE rules_fired > 0) AS baseline_alerts,
  (SELECT count(*) FROM final WHERE rules_fired > 0) - (SELECT count(*) FROM final WHERE final_alert)
    AS fewer_alerts,
  (SELECT count(*) FROM final) AS transactions,
  (SELECT CAST(count(*) FILTER (structuring) AS BIGINT) FROM final) AS structuring_alerts
FROM queue""",
    ),
)
def payload_document(spark, sf_dir):
    """V4: headline, strategies, book, rules and cases as one document, read back from JSON."""
    decided, ranking = _decided(spark, sf_dir)
    decided = stage(decided, "decided")
    queue = stage(cases.queue(cases.open_cases(decided, ranking)), "queue")
    strategies = stage(evaluation.strategy_metrics(decided, ranking), "strategies")
    by_rule = evaluation.rule_metrics(decided)
    document = evidence.payload_document(
        evidence.case_payload(queue, decided, band_low=0.60),
        strategies,
        evidence.rule_summary(by_rule, evaluation.rule_contribution(decided)),
        decided.agg(F.count(F.lit(1)).alias("transactions")),
        page=_PAGE,
    )
    path = new_folder(spark, "payload")
    files.write_json(document, path)
    read = spark.read.schema(document.schema).json(path)
    first = read.filter("page = 0").select(
        F.col("headline.combined_alerts").alias("n_cases"),
        F.col("baseline.alerts").alias("baseline_alerts"),
        (F.col("headline.baseline_alerts") - F.col("combined.alerts")).alias("fewer_alerts"),
        F.col("dataset.transactions").alias("transactions"),
        F.expr("filter(rules, r -> r.name = 'structuring')[0].alerts").alias("structuring_alerts"),
    )
    listed = read.select("page", F.explode("cases").alias("c"))
    # one row, by construction
    return listed.select(
        "page",
        "c.id",
        "c.amount",
        F.array_join("c.reasons", "|").alias("reasons"),
        "c.priority",
        *[first.select(c).scalar().alias(c) for c in first.columns],
    )


_SHIFT = "greatest(length(bin(pennies)) - 8, 0)"
_SKETCH_SQL = f"""
cells AS (
  SELECT (pennies >> s) << s AS low, ((pennies >> s) << s) + (CAST(1 AS BIGINT) << s) - 1 AS high, count(*) AS n
  FROM (SELECT pennies, CAST({_SHIFT} AS BIGINT) AS s
        FROM (SELECT CAST(round(amount * 100) AS BIGINT) AS pennies FROM raw_book WHERE amount > 0))
  GROUP BY 1, 2),
placed AS (
  SELECT *, CAST(sum(n) OVER (ORDER BY low) AS BIGINT) AS rank_to, CAST(sum(n) OVER () AS BIGINT) AS total
  FROM cells),
truth AS (
  SELECT CAST(round(amount * 100) AS BIGINT) AS pennies, row_number() OVER (ORDER BY amount) AS place
  FROM raw_book WHERE amount > 0)"""


@query(
    "profile_amounts_sketch",
    with_tables(
        RAW + "," + _SKETCH_SQL,
        """SELECT p / 1000000.0 AS p, total AS rows, rank, (low + high) / 2.0 AS estimate, low, high,
  rank_to - n + 1 AS rank_from, rank_to,
  pennies AS exact, abs((low + high) / 2.0 - pennies) <= pennies / 128.0 AS within
FROM placed, (SELECT unnest([500000, 900000, 990000, 999000]) AS p),
  LATERAL (SELECT (total * p + 999999) // 1000000 AS rank) JOIN truth ON place = rank
WHERE rank BETWEEN rank_to - n + 1 AND rank_to""",
    ),
)
def profile_amounts_sketch(spark, sf_dir):
    """A8, A9: merged sketches per channel, next to the exact penny at each rank."""
    probs = (0.5, 0.9, 0.99, 0.999)
    raw = testbook.raw_text(spark, sf_dir)
    amounts = raw.select("channel", profiling.amount_of(raw).alias("amount")).filter("amount > 0")
    cells = sketch.merged(sketch.sketch(amounts, "amount", ["channel"]).drop("channel"))
    found = sketch.quantiles(cells, probs)
    exact = profiling.values_at_ranks(amounts, "amount", found.select("rank"))
    joined = found.join(exact.select("rank", F.round(F.col("value") * 100).cast("bigint").alias("exact")), "rank")
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") / 2**sketch.BITS
    return joined.withColumn("within", within)
