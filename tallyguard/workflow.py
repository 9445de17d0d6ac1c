"""The whole run: profile, clean, detect, score, combine, measure, queue.

Tables that several later steps read are written once; every output stays a Spark write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import (
    cases,
    cleaning,
    evaluation,
    evidence,
    features,
    isolation,
    network,
    profiling,
    rules,
)
from .operators.evaluation import Ranking
from .plans import HotKeys, find_hot, stage, together
from .sources.files import write_json, write_table
from .sources.sinks import observed_metrics, publish, read_published


def profile(raw_text: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """All profile tables, lazily."""
    return {
        "missing": profiling.missing_values(raw_text),
        "duplicates": profiling.duplicate_summary(raw_text),
        "duplicate_sample": profiling.duplicate_rows(raw_text),
        "duplicate_differences": profiling.duplicate_differences(raw_text),
        "negative_amounts": profiling.negative_amounts(raw_text),
        "negative_by_type": profiling.negative_by_type(raw_text),
        "amounts": profiling.amount_distribution(raw_text),
        "timestamp_formats": profiling.timestamp_formats(raw_text),
        "country_spellings": profiling.country_spellings(raw_text),
        "canonical_countries": profiling.canonical_countries(customers),
        "categories": profiling.category_counts(raw_text),
        "id_prefixes": profiling.id_prefixes(raw_text),
        "accounts": profiling.account_activity(raw_text, customers),
    }


def write_profile(raw_text: DataFrame, customers: DataFrame, out: str) -> None:
    tables = profile(raw_text, customers)
    together(
        *[
            lambda name=name, table=table: write_json(table, f"{out}/profile/{name}")
            for name, table in tables.items()
        ]
    )


def clean(
    raw: DataFrame,
    customers: DataFrame,
    out: str,
    spellings: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the clean book and the quarantine; return both and the log."""
    spark = raw.sparkSession
    trace = stage(cleaning.traced(raw, customers, spellings), "traced")
    kept, rejected, log = (
        cleaning.clean_book(trace),
        cleaning.quarantine(trace),
        cleaning.cleaning_log(trace),
    )
    together(
        lambda: write_table(kept, f"{out}/transactions_clean"),
        lambda: write_table(rejected, f"{out}/quarantined_rows"),
        lambda: write_json(log, f"{out}/cleaning_log"),
    )
    return (
        spark.read.schema(kept.schema).parquet(f"{out}/transactions_clean"),
        spark.read.schema(rejected.schema).parquet(f"{out}/quarantined_rows"),
        log,
    )


def publish_clean(
    raw: DataFrame,
    customers: DataFrame,
    out: str,
    run: str,
    spellings: dict[str, str] | None = None,
    unreadable: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`clean` as one write that can be repeated: clean book, quarantine and log of ``run``.

    Both parts are subfolders of a single publication, the log was counted by its tasks. A run
    that is published already is read, not made again; one that broke off leaves no trace in
    what is read.
    """
    spark, path = raw.sparkSession, f"{out}/transactions"
    rows = cleaning.with_verdict(cleaning.traced(raw, customers, spellings), unreadable)
    publish(rows, path, run, by=(cleaning.VERDICT,), metrics=cleaning.log_metrics())
    written = read_published(spark, path, run)
    return (
        cleaning.clean_book(written.filter(F.col(cleaning.VERDICT) == cleaning.KEPT)),
        cleaning.quarantine(written.filter(F.col(cleaning.VERDICT) == cleaning.REJECTED)),
        cleaning.observed_log(observed_metrics(spark, path, run), written),
    )


def score(book: DataFrame, customers: DataFrame, hot: HotKeys, **forest_options):
    """Anomaly scores of a forest fitted on the book, its node table and category levels."""
    levels = features.observed_levels(book)
    names = features.feature_names(levels)
    matrix = features.build_features(book, customers, levels, hot, keep=(rules.ROW,))
    matrix = stage(matrix, "features")
    forest, model = isolation.fit_forest(matrix, names, **forest_options)
    return stage(forest.apply(matrix).select(rules.ROW, "score"), "scores"), model, levels


REPORT = (
    "dataset",
    "rules",
    "contribution",
    "strategies",
    "sweep",
    "headline",
    "rule_summary",
    "case_counts",
    "network_summary",
)


def metrics_report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row with an array of records per table; every table has a few rows by design."""
    return spark.range(1).select(
        *[
            t.agg(F.collect_list(F.struct(*t.columns)).alias("rows")).scalar().alias(name)
            for name, t in tables.items()
        ]
    )


def detect(
    book: DataFrame,
    quarantine: DataFrame,
    customers: DataFrame,
    label_file: DataFrame,
    out: str,
    params: dict[str, dict] | None = None,
    **forest_options,
) -> dict[str, DataFrame]:
    """Rules, model, combination, metrics, case list, payload and account graph."""
    book = rules.with_clock(rules.with_row_key(book))
    hot = find_hot(book)
    (scores, model, levels), flagged, hops, partnered, accounts = together(
        lambda: score(book, customers, hot, **forest_options),
        lambda: stage(
            evaluation.with_labels(rules.apply_all(book, params, hot), label_file), "flagged"
        ),
        lambda: stage(network.chains(book), "hops"),
        lambda: stage(evaluation.with_labels(network.with_partners(book), label_file), "partners"),
        lambda: stage(network.funnel_accounts(book), "funnels"),
    )
    scored = stage(evaluation.with_scores(flagged, scores), "scored")
    ranking = Ranking(scored)
    decided = evaluation.combined(scored, ranking)
    queue, strategies, by_rule = together(
        lambda: stage(cases.queue(cases.open_cases(decided, ranking)), "queue"),
        lambda: stage(evaluation.strategy_metrics(decided, ranking), "strategies"),
        lambda: stage(evaluation.rule_metrics(flagged), "rule-metrics"),
    )
    contribution = evaluation.rule_contribution(flagged)
    band = {
        k: v
        for k, v in (params or {}).get("structuring", {}).items()
        if k in ("threshold", "band_low")
    }
    tables = {
        "dataset": evaluation.dataset_accounting(label_file, book, quarantine),
        "rules": by_rule,
        "contribution": contribution,
        "strategies": strategies,
        "sweep": evaluation.calibration_sweep(scored, ranking),
        "headline": evaluation.headline(strategies, "any_rule", "combined_final"),
        "rule_summary": evidence.rule_summary(by_rule, contribution),
        "case_counts": cases.case_counts(queue),
        "gain": ranking.gain(),
        "case_list": queue.select(*cases.CASE_COLUMNS),
        "payload": evidence.case_payload(queue, book, hot=hot, **band),
        "funnels": accounts.filter("is_funnel"),
        "chains": hops,
        "network_summary": network.summary(partnered, accounts),
        "transactions_scored": decided.drop(rules.ROW),
    }
    report = [k for k in REPORT if k in tables]
    tables["metrics_report"] = metrics_report(book.sparkSession, {k: tables[k] for k in report})
    as_table = {"case_list", "funnels", "chains", "gain", "transactions_scored"}
    together(
        lambda: isolation.save_model(
            model, features.feature_names(levels), levels, f"{out}/forest"
        ),
        *[
            lambda name=name, table=table: (write_table if name in as_table else write_json)(
                table, f"{out}/{name}"
            )
            for name, table in tables.items()
        ]
    )
    return {**tables, "scored": scored, "queue": queue}


def run(
    raw_text: DataFrame,
    raw: DataFrame,
    customers: DataFrame,
    label_file: DataFrame,
    out: str,
    spellings: dict[str, str] | None = None,
    params: dict[str, dict] | None = None,
    **forest_options,
) -> dict[str, DataFrame]:
    """Everything, from the raw feed to the analyst queue, under the folder ``out``.

    The feed is read twice, as text and typed, and staged: all later passes read columns.
    """
    raw_text, raw = together(lambda: stage(raw_text, "raw-text"), lambda: stage(raw, "raw"))
    _, (book, quarantine, log) = together(
        lambda: write_profile(raw_text, customers, out),
        lambda: clean(raw, customers, out, spellings),
    )
    tables = detect(book, quarantine, customers, label_file, out, params, **forest_options)
    return {**tables, "cleaning_log": log, "quarantine": quarantine, "book": book}
