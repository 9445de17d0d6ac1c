"""What keeps the work of the model, the what-if layers and the neighbours in proportion to the rows."""

import hashlib
import os

import numpy as np
import pytest
from conftest import book_of, skewed_rows
from pyspark.sql import functions as F

from tallyguard.operators import features, isolation, lof, projection, rules, whatif
from tallyguard.plans.stage import stage_root

PEOPLE = "account_id string, home_country string, account_open_date date"


def test_trees_are_drawn_in_batches_as_defined(spark):
    rows = spark.range(3_000).select(
        F.when(F.col("id") != 7, F.concat(F.lit("T"), "id")).alias("transaction_id"), F.col("id").cast("double").alias("f")
    )
    drawn = isolation.samples(rows, ["f"], 3_000, trees=20, tree_rows=64, seed=3)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan  # no row goes through 20 expressions
    limit = np.ceil(min(1.0, (64 + 6 * 8) / 3_000) * isolation.PRIME)
    expected = set()
    for i in range(3_000):
        number = int(hashlib.md5(f"T{i}".encode()).hexdigest()[:15], 16)
        for tree in range(20):
            a, b, c = isolation.row_factors(3, tree)
            draw = (a * (number % 2**30) + b * (number // 2**30) + c) % isolation.PRIME
            if i != 7 and draw < limit:
                expected.add((tree, draw, number, float(i)))
    got = [(r["tree"], r["draw"], r["row"], r["x"][0]) for r in drawn.collect()]
    assert len(got) == len(expected) and set(got) == expected


@pytest.fixture()
def marked(spark):
    case = F.col("amount") >= 8_000
    book = book_of(spark, skewed_rows(300))
    flags = {whatif.STRUCTURING_TARGET: case, whatif.RAPID_TARGET: F.col("amount") < 2_000, "label": case.cast("int")}
    return book.withColumns(flags)


def test_only_the_features_a_model_reads_are_built(spark, marked):
    people = spark.createDataFrame([], PEOPLE)
    levels = features.observed_levels(marked)
    full = features.build_features(marked, people, levels)
    some = ["amount_z_vs_account", "receiver_velocity_24h", "is_night", "channel_online_transfer"]
    few = features.build_features(marked, people, levels, names=some)
    assert few.columns == ["transaction_id", *some[:1], "is_night", "receiver_velocity_24h", "channel_online_transfer"]
    assert sorted(few.collect()) == sorted(full.select(*few.columns).collect())
    narrow = features.build_features(marked, people, levels, names=some[:1])
    assert "Generate" not in narrow._jdf.queryExecution().executedPlan().toString()  # no probes on the timeline
    for names in (["hour"], ["sender_account_age_days"], ["sender_txn_count", "receiver_distinct_counterparties"]):
        few = features.build_features(marked, people, levels, names=names)
        assert sorted(few.collect(), key=str) == sorted(full.select(*few.columns).collect(), key=str)


def test_whatif_layers_write_only_what_their_metrics_read(spark, marked, monkeypatch):
    written, plain = [], whatif.stage

    def spy(df, name):
        written.append((name, df.columns))
        return plain(df, name)

    monkeypatch.setattr(whatif, "stage", spy)

    class Amount:
        names = ["log_amount"]

        def apply(self, matrix):
            return matrix.withColumn("score", F.col("log_amount"))

    people = spark.createDataFrame([], PEOPLE)
    scenarios = {"control": None, "smaller": whatif.smaller_payments}
    rows = whatif.layer_recall(marked, people, Amount(), features.observed_levels(marked), None, scenarios).collect()
    assert [r["scenario"] for r in rows] == list(scenarios)
    assert sum(name == "whatif-original" for name, _ in written) == 1
    scored = [set(columns) for name, columns in written if name == "scored"]
    assert len(scored) == 2 and all(c == {"label", "score", "rule_alert", *rules.RULES} for c in scored)


def points_of(spark, n, dims, seed=4):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n // 20, dims))[rng.integers(0, n // 20, n)] + rng.normal(size=(n, dims)) * 0.3).tolist()
    return spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "point bigint, x array<float>, copies bigint")


def test_exact_neighbours_repeat_no_point_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lof, "CELL_POINTS", 40)
    monkeypatch.setattr(lof, "BLOCK", 32)
    staged, plain = {}, lof.stage

    def spy(df, name):
        staged[name] = plain(df, name)
        return staged[name]

    monkeypatch.setattr(lof, "stage", spy)
    points = points_of(spark, 1_500, 6)
    near = lof.neighbours(points, 8)
    assert near.count() == 1_500 * 8
    x = np.array([r["x"] for r in points.orderBy("point").collect()], dtype=float)
    found = {}
    for r in near.collect():
        found.setdefault(r["q"], []).append((r["dist"], r["o"]))
    for q in range(0, 1_500, 100):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert {o for _, o in found[q]} == set(np.argsort(d)[:8].tolist())
    assert sum(len(r["ids"]) // 8 for r in staged["blocks"].collect()) == 1_500  # every point once
    assert staged["neighbours"].count() == 1_500 * 8 and set(staged) == {"cells", "blocks", "neighbours"}


def test_a_pair_is_listed_by_the_first_table_it_meets_in(spark):
    points = points_of(spark, 2_000, 4)
    cells = projection._with_cells(points, 4, 6, 100)
    assert cells.count() == 2_000  # a point is written once, not once per table
    rows = projection._cells(points, 4, 6, 100).withColumns({c: F.lit(0) for c in ("i", "j", "block")})
    found = rows.groupBy("table", "cell", "i", "j").applyInArrow(projection._tile(10), projection._LISTS)
    pairs = found.select("q", F.explode("o").alias("o"))
    assert pairs.count() == pairs.distinct().count()


def test_scenarios_of_a_large_book_leave_nothing_behind(spark, marked, monkeypatch):
    monkeypatch.setattr(whatif, "SIDE_BY_SIDE", 10, raising=False)
    monkeypatch.setattr(whatif, "AT_ONCE", 1, raising=False)
    top = f"{stage_root(spark)}/tallyguard-{spark.sparkContext.applicationId}"
    held, most, plain = set(os.listdir(top)) if os.path.isdir(top) else set(), [], whatif.stage

    def spy(df, name):
        out = plain(df, name)
        most.append(sum(f.startswith("scored-") for f in {*os.listdir(top)} - held))
        return out

    monkeypatch.setattr(whatif, "stage", spy)

    class Amount:
        names = ["log_amount"]

        def apply(self, matrix):
            return matrix.withColumn("score", F.col("log_amount"))

    people = spark.createDataFrame([], PEOPLE)
    scenarios = {"control": None, "smaller": whatif.smaller_payments, "pence": whatif.add_pence}
    found = whatif.layer_recall(marked, people, Amount(), features.observed_levels(marked), None, scenarios)
    assert [r["scenario"] for r in found.collect()] == list(scenarios)
    assert max(most) == 1  # one scenario's files at a time
    assert set(os.listdir(top)) == held  # and none of them afterwards


def test_tables_that_are_merged_in_turn_find_the_same_neighbours(spark, monkeypatch):
    points = points_of(spark, 1_500, 4)
    once = sorted(projection.projected_neighbours(points, 8, tables=5, leaf=100).collect())
    turns, plain = [], projection.stage

    def spy(df, name):
        out = plain(df, name)
        if name == "projected":
            turns.append(sum(f.startswith("projected-") for f in os.listdir(os.path.dirname(out._staged))))
        return out

    monkeypatch.setattr(projection, "stage", spy)
    monkeypatch.setattr(projection, "AT_ONCE", 3_000, raising=False)
    found = projection.projected_neighbours(points, 8, tables=5, leaf=100)
    assert sorted(found.collect()) == once
    assert len(turns) == 3  # two tables, two more, the last one
    assert turns[2] - turns[0] <= 1  # what is merged is removed when the next turn is written


def test_outlier_factors_in_slices_are_the_same(spark, monkeypatch):
    near = lof.neighbours(points_of(spark, 400, 3), 8)
    whole = {r["point"]: r["lof"] for r in lof.outlier_factors(near).collect()}
    names, plain = [], lof.stage
    monkeypatch.setattr(lof, "stage", lambda df, name: (names.append(name), plain(df, name))[1])
    monkeypatch.setattr(lof, "LISTED", 1_000, raising=False)
    parts = {r["point"]: r["lof"] for r in lof.outlier_factors(near).collect()}
    assert parts == pytest.approx(whole) and names.count("density") == 4
