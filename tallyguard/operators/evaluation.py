"""Measurement against labels and the combination of rules with a score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numbers import ratio
from ..plans import attach_by_value, ladder, numbered
from .rules import RULES

LABEL = "label"


def distinct_labels(label_file: DataFrame) -> DataFrame:
    """One label per transaction; replayed label rows agree with each other."""
    return label_file.groupBy("transaction_id").agg(F.max("is_laundering_pattern").alias(LABEL))


def with_labels(df: DataFrame, label_file: DataFrame) -> DataFrame:
    """Attach labels; a transaction without one counts as negative."""
    return df.join(distinct_labels(label_file), "transaction_id", "left").withColumn(
        LABEL, F.coalesce(LABEL, F.lit(0))
    )


def with_scores(flagged: DataFrame, scores: DataFrame, score: str = "score") -> DataFrame:
    """Attach scores by ``row_key``; rows alike in every column share the smallest of theirs."""
    single = scores.groupBy("row_key").agg(F.min(score).alias(score))
    return flagged.join(single, "row_key")


def any_of(names: Iterable[str]) -> Column:
    first, *rest = [F.col(n) for n in names]
    for flag in rest:
        first = first | flag
    return first


def tier_a() -> Column:
    return any_of(C.TIER_A)


def tier_b() -> Column:
    return any_of(C.TIER_B)


def confusion(df: DataFrame, flags: dict[str, Column], name: str = "strategy") -> DataFrame:
    """Alert metrics of any number of flags, one row each, in a single pass."""
    hit = F.col(LABEL) == 1
    counts = [
        F.struct(
            F.lit(key).alias(name),
            F.count_if(flag).alias("alerts"),
            F.count_if(flag & hit).alias("true_positives"),
        )
        for key, flag in flags.items()
    ]
    rows = df.agg(
        F.array(*counts).alias("m"),
        F.count(F.lit(1)).alias("book_rows"),
        F.count_if(hit).alias("positives"),
    ).select(F.inline("m"), "book_rows", "positives")
    tp, alerts = F.col("true_positives"), F.col("alerts")
    zero = F.lit(0.0)
    return rows.select(
        name,
        "alerts",
        "true_positives",
        (alerts - tp).alias("false_positives"),
        (F.col("positives") - tp).alias("false_negatives"),
        ratio(tp, F.col("positives")).alias("recall"),
        F.coalesce(ratio(tp, alerts), zero).alias("precision"),
        F.coalesce(ratio(alerts - tp, alerts), zero).alias("false_positive_rate_of_alerts"),
        ratio(alerts, F.col("book_rows")).alias("alert_rate_of_book"),
    )


def rule_metrics(flagged: DataFrame) -> DataFrame:
    """Every rule on its own and all of them together."""
    flags = {r: F.col(r) for r in RULES}
    return confusion(flagged, {**flags, "any_rule": F.col("rule_alert")}, "rule")


def tier_metrics(flagged: DataFrame) -> DataFrame:
    return confusion(flagged, {"tier_a": tier_a(), "tier_b": tier_b()}, "tier")


def rule_contribution(flagged: DataFrame) -> DataFrame:
    """Alert volume of each rule and what no other rule would have raised."""
    hit, alone = F.col(LABEL) == 1, F.col("rules_fired") == 1
    counts = [
        F.struct(
            F.lit(r).alias("rule"),
            F.count_if(r).alias("alerts"),
            F.count_if(F.col(r) & hit).alias("cases_caught"),
            F.count_if(F.col(r) & alone).alias("alerts_only_this_rule"),
            F.count_if(F.col(r) & alone & hit).alias("cases_no_other_rule_found"),
        )
        for r in RULES
    ]
    rows = flagged.agg(F.array(*counts).alias("m")).select(F.inline("m"))
    return rows.select(
        "*", ratio(F.col("cases_caught") * 100, F.col("alerts"), 2).alias("precision_pct")
    )


def rule_shares(flagged: DataFrame) -> DataFrame:
    """Share of the book each rule raises."""
    rows = flagged.agg(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.count_if(r).alias("alerts"))
                for r in (*RULES, "rule_alert")
            ]
        ).alias("m"),
        F.count(F.lit(1)).alias("n"),
    ).select(F.inline("m"), "n")
    return rows.select("rule", "alerts", ratio(F.col("alerts"), F.col("n")).alias("share_of_book"))


def dataset_accounting(label_file: DataFrame, clean: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Where the known cases went: in the file, surviving cleaning, lost in quarantine.

    The three tables meet in one grouping by id, combined map-side.
    """
    zero = F.lit(0)
    parts = [
        label_file.select("transaction_id", F.col("is_laundering_pattern").alias("positive"),
                          zero.alias("clean"), zero.alias("lost")),
        clean.select("transaction_id", zero.alias("positive"), F.lit(1).alias("clean"),
                     zero.alias("lost")),
        quarantine.select("transaction_id", zero.alias("positive"), zero.alias("clean"),
                          F.lit(1).alias("lost")),
    ]
    per_id = (
        parts[0].union(parts[1]).union(parts[2])
        .groupBy("transaction_id")
        .agg(
            F.max("positive").alias("label"),
            F.sum("positive").alias("positive_rows"),
            F.sum("clean").alias("clean"),
            F.sum("lost").alias("lost"),
        )
    )
    sums = per_id.agg(
        F.sum("clean").alias("clean_rows"),
        F.sum("positive_rows").alias("positive_rows_in_label_file"),
        F.sum("label").cast("bigint").alias("distinct_positive_transactions"),
        F.sum(F.col("label") * F.col("clean")).alias("known_positives_surviving_cleaning"),
        F.sum(F.col("label") * F.col("lost")).alias("known_positives_lost_in_quarantine"),
    )
    return sums.withColumn(
        "recall_ceiling",
        ratio(
            F.col("known_positives_surviving_cleaning"), F.col("distinct_positive_transactions")
        ),
    )


# --- scores ---------------------------------------------------------------------


class Ranking:
    """Percentiles and cut-offs of one score column.

    Built on the ladder of distinct scores; a percentile test on rows becomes a test
    against a score cut-off, so rows need no rank of their own.
    """

    def __init__(self, scored: DataFrame, score: str = "score"):
        self.score = score
        self.steps = ladder(scored, score, {"cases": F.col(LABEL).cast("bigint")})
        row = self.steps.agg(F.sum("n"), F.sum("cases")).first()
        self.rows, self.cases = row[0] or 0, row[1] or 0
        self.steps = self.steps.withColumn("pct", self._pct())

    def _pct(self) -> Column:
        mid = F.col("n_before").cast("double") + (F.col("n").cast("double") + 1) / 2
        return mid / F.lit(float(max(self.rows, 1)))

    def percentile_cutoffs(self, thresholds: Iterable[float]) -> dict[float, float]:
        """Lowest score whose percentile reaches each threshold."""
        thresholds = list(thresholds)
        row = self.steps.agg(
            *[F.min(F.when(F.col("pct") >= t, F.col(self.score))) for t in thresholds]
        ).first()
        return dict(zip(thresholds, row))

    def budget_cutoff(self, budget: int) -> float | None:
        """The ``budget``-th largest score, ties counted."""
        at_or_above = F.lit(self.rows) - F.col("n_before")
        return self.steps.agg(
            F.max(F.when(at_or_above >= min(max(budget, 1), self.rows), F.col(self.score)))
        ).first()[0]

    def at_least(self, cutoff: float | None) -> Column:
        """Rows at or above a cut-off; none where no score reaches it."""
        if cutoff is None:
            return F.lit(False)
        return F.coalesce(F.col(self.score) >= F.lit(cutoff), F.lit(False))

    def percentiles(self, rows: DataFrame) -> DataFrame:
        """Attach ``anomaly_pct`` to rows."""
        steps = self.steps.select(self.score, "n", F.col("pct").alias("anomaly_pct"))
        return attach_by_value(rows, steps, self.score).drop("n")

    def gain(self) -> DataFrame:
        """Cases caught when reviewing from the top, per distinct score."""
        return self.steps.select(
            self.score,
            (F.lit(self.rows) - F.col("n_before")).alias("alerts_reviewed"),
            (F.lit(self.cases) - F.col("cases_before")).alias("cases_caught"),
        )

    def alerts_to_catch_all(self) -> DataFrame:
        """Reviews needed until the last case, a tied group being reviewed whole."""
        return self.gain().filter(F.col("cases_caught") == self.cases).agg(
            F.min("alerts_reviewed").alias("alerts_to_catch_all"),
            F.max("cases_caught").alias("cases"),
        )


def recall_at_budget(scored: DataFrame, ranking: Ranking, budget: int, name: str) -> DataFrame:
    """Cases among exactly ``budget`` top-scored rows, ties settled by transaction id."""
    score, cutoff = ranking.score, ranking.budget_cutoff(budget)
    above = ranking.steps.filter(F.col(score) > cutoff).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("cases"), F.lit(0))
    ).first()
    tied = numbered(
        scored.filter(F.col(score) == cutoff).select("transaction_id", LABEL),
        [F.col("transaction_id")],
    )
    caught = tied.filter(F.col("position") <= budget - above[0]).agg(
        (F.coalesce(F.sum(LABEL), F.lit(0)) + F.lit(above[1])).cast("bigint").alias("cases_caught")
    )
    total = F.lit(ranking.cases).cast("bigint")
    return caught.select(
        F.lit(name).alias("detector"),
        "cases_caught",
        total.alias("of"),
        ratio(F.col("cases_caught"), total).alias("recall"),
        ratio(F.col("cases_caught"), F.lit(budget)).alias("precision"),
    )


def calibration_sweep(
    scored: DataFrame, ranking: Ranking, thresholds: Iterable[float] = C.SWEEP
) -> DataFrame:
    """Combined metrics for each corroboration threshold, in one pass over the book."""
    cutoffs = ranking.percentile_cutoffs(thresholds)
    flags = {
        str(t): tier_a() | (tier_b() & ranking.at_least(cut)) for t, cut in cutoffs.items()
    }
    out = confusion(scored, flags, "threshold")
    return out.withColumn("tier_b_threshold_pct", F.col("threshold").cast("double")).drop(
        "threshold"
    )


def combined(
    scored: DataFrame,
    ranking: Ranking,
    corroborate: float = C.TIER_B_PERCENTILE,
    alone: float = C.ANOMALY_ONLY_PERCENTILE,
) -> DataFrame:
    """Targeted rules as they are, broad ones when corroborated, and the extreme scores."""
    cuts = ranking.percentile_cutoffs([corroborate, alone])
    by_tier_b = tier_b() & ranking.at_least(cuts[corroborate])
    out = scored.withColumns({"tier_a": tier_a(), "corroborated": by_tier_b})
    by_rules = F.col("tier_a") | F.col("corroborated")
    out = out.withColumn("ml_only", ranking.at_least(cuts[alone]) & ~by_rules)
    return out.withColumns(
        {
            "final_alert": by_rules | F.col("ml_only"),
            "escalation_channel": F.when(F.col("tier_a"), "rule: targeted typology")
            .when(F.col("corroborated"), "rule: broad screen + anomaly corroboration")
            .when(F.col("ml_only"), "anomaly only")
            .otherwise(""),
        }
    )


def strategy_metrics(decided: DataFrame, ranking: Ranking) -> DataFrame:
    """Baseline, tiers, combination, and the score alone at the combination's volume."""
    budget = decided.filter("final_alert").count()
    return confusion(
        decided,
        {
            "any_rule": F.col("rule_alert"),
            "tier_a_only": F.col("tier_a"),
            "ml_only_channel": F.col("ml_only"),
            "combined_final": F.col("final_alert"),
            "ml_alone_same_budget": ranking.at_least(ranking.budget_cutoff(budget)),
        },
    )


def headline(metrics: DataFrame, baseline: str, final: str, name: str = "strategy") -> DataFrame:
    """Reductions between two strategies of a metrics table (a handful of rows)."""

    def of(which: str, column: str) -> Column:
        return F.max(F.when(F.col(name) == which, F.col(column)))

    row = metrics.agg(
        *[
            of(which, c).alias(f"{prefix}_{c}")
            for prefix, which in (("baseline", baseline), ("combined", final))
            for c in ("alerts", "false_positives", "recall", "precision")
        ]
    )
    fewer = F.col("baseline_alerts") - F.col("combined_alerts")
    fewer_false = F.col("baseline_false_positives") - F.col("combined_false_positives")
    return row.select(
        "*",
        ratio(fewer * 100, F.col("baseline_alerts"), 1).alias("alert_volume_reduction_pct"),
        ratio(fewer_false * 100, F.col("baseline_false_positives"), 1).alias(
            "false_positive_reduction_pct"
        ),
        F.round(fewer * F.lit(C.HOURS_PER_ALERT), 1).alias("analyst_hours_saved"),
    )
