"""Global ranks, percentiles, cut-offs and metrics against plain Python and pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyguard.operators import evaluation, profiling
from tallyguard.operators.evaluation import Ranking
from tallyguard.plans import attach_by_value, ladder, numbered


@pytest.fixture(scope="module")
def table():
    rng = random.Random(3)
    # a third of all rows share one score
    scores = [0.0 if rng.random() < 0.34 else round(rng.gauss(0, 1), 2) for _ in range(900)]
    return pd.DataFrame(
        {
            "transaction_id": [f"T{i:04d}" for i in range(900)],
            "score": scores,
            "label": [int(rng.random() < 0.1) for _ in range(900)],
        }
    )


@pytest.fixture(scope="module")
def scored(spark, table):
    return spark.createDataFrame(table)


@pytest.fixture(scope="module")
def ranking(scored):
    return Ranking(scored)


def test_percentile_rank_matches_average_ties(scored, ranking, table):
    got = {r["transaction_id"]: r["anomaly_pct"] for r in ranking.percentiles(scored).collect()}
    want = table["score"].rank(pct=True)
    for key, value in zip(table["transaction_id"], want):
        assert got[key] == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize("theta", [0.0, 0.5, 0.9, 0.99, 0.999, 1.0])
def test_cutoffs_select_the_same_rows(scored, ranking, table, theta):
    cut = ranking.percentile_cutoffs([theta])[theta]
    got = scored.filter(ranking.at_least(cut)).count()
    assert got == int((table["score"].rank(pct=True) >= theta).sum())


@pytest.mark.parametrize("budget", [1, 10, 228, 600, 900, 5000])
def test_budget_cutoff(ranking, table, budget):
    assert ranking.budget_cutoff(budget) == table["score"].nlargest(budget).min()


@pytest.mark.parametrize("budget", [5, 100, 400])
def test_recall_at_budget(scored, ranking, table, budget):
    got = evaluation.recall_at_budget(scored, ranking, budget, "d").first()
    top = table.sort_values(["score", "transaction_id"], ascending=[False, True]).head(budget)
    assert got["cases_caught"] == top["label"].sum() and got["of"] == table["label"].sum()


def test_ladder_totals(scored, table):
    steps = ladder(scored, "score", {"cases": F.col("label")}).collect()
    assert len(steps) == table["score"].nunique()
    for s in steps:
        below = table[table["score"] < s["score"]]
        assert (s["n_before"], s["cases_before"]) == (len(below), below["label"].sum())


def test_rows_numbered_across_partitions(scored, table):
    got = numbered(scored, [F.desc("score"), F.asc("transaction_id")])
    want = table.sort_values(["score", "transaction_id"], ascending=[False, True])
    assert [r["transaction_id"] for r in got.orderBy("position").collect()] == list(
        want["transaction_id"]
    )
    assert [r["position"] for r in got.orderBy("position").collect()] == list(range(1, 901))


def test_common_values_are_joined_apart(scored, ranking, table):
    steps = ranking.steps.select("score", "n", "pct")
    parted = attach_by_value(scored, steps, "score", limit=20, share=0.01)
    assert parted.count() == len(table)
    assert parted.filter("score = 0").count() == int((table["score"] == 0).sum())


def test_distribution(spark, table):
    got = profiling.distribution(spark.createDataFrame(table[["score"]]), "score").first()
    want = table["score"].describe(percentiles=[0.5, 0.9, 0.99, 0.999])
    for ours, theirs in (
        ("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"),
        ("p50", "50%"), ("p90", "90%"), ("p99", "99%"), ("p99_9", "99.9%"),
    ):
        assert got[ours] == pytest.approx(want[theirs], rel=1e-9)


def test_empty_scores(spark):
    empty = spark.createDataFrame([], "transaction_id string, score double, label int")
    ranking = Ranking(empty)
    assert ranking.budget_cutoff(5) is None
    assert empty.filter(ranking.at_least(None)).count() == 0


def test_confusion_without_alerts_or_cases(spark):
    rows = spark.createDataFrame([("T1", 0), ("T2", 0)], "transaction_id string, label int")
    got = evaluation.confusion(rows, {"none": F.lit(False), "all": F.lit(True)}).collect()
    by_name = {r["strategy"]: r for r in got}
    assert by_name["none"]["precision"] == 0.0 and by_name["none"]["recall"] is None
    assert by_name["all"]["false_positive_rate_of_alerts"] == 1.0


def test_priority_bins_are_right_closed(spark):
    from tallyguard.functions.numbers import priority

    df = spark.createDataFrame([(0.0,), (0.9,), (0.9001,), (0.99,), (0.9901,), (1.0,)], "p double")
    got = [r[0] for r in df.select(priority(F.col("p"))).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "high"]


def test_many_small_ranges(scored, table, monkeypatch):
    import sys

    monkeypatch.setattr(sys.modules["tallyguard.plans.ladder"], "RANGE_ROWS", 40)
    rows = numbered(scored, [F.asc("score"), F.asc("transaction_id")]).orderBy("position").collect()
    want = table.sort_values(["score", "transaction_id"])["transaction_id"].tolist()
    assert [r["transaction_id"] for r in rows] == want
    assert [r["position"] for r in rows] == list(range(1, len(want) + 1))
