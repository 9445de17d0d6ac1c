"""Isolation forest and local outlier factor against plain implementations."""

import json
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyguard.operators import detectors, isolation, lof, pipeline, projection
from tallyguard.operators.isolation import expected_path, grow, path_lengths

NAMES = [f"f{i}" for i in range(4)]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(11)
    points = rng.normal(size=(700, 4)).astype(np.float32)
    points[:5] += 9  # planted outliers
    points[300:560] = points[300]  # over a third of the rows are copies of one
    return points


def frame(spark, points):
    rows = [(f"T{i:04d}", *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, ["transaction_id", *NAMES]).withColumn("label", F.lit(0))


def walk(tree, x):
    at = 0
    while math.isfinite(tree["cut"][at]):
        at = tree["child"][at] + int(x[tree["feature"][at]] > tree["cut"][at])
    return tree["path"][at]


def test_tree_shape(cloud):
    tree = grow(cloud, 42, 1)
    arrays = tuple(tree[c] for c in ("feature", "cut", "child", "path"))
    lengths = path_lengths(cloud, arrays)
    assert lengths.tolist() == [walk(tree, x) for x in cloud]
    inner = np.isfinite(tree["cut"])
    assert sorted(np.concatenate([tree["child"][inner], tree["child"][inner] + 1])) == list(
        range(1, len(inner))
    )
    assert lengths.max() <= math.ceil(math.log2(700)) + expected_path(700)


def test_paths_follow_the_published_distribution():
    """Mean leaf depth of uniform points is close to the expected path of a random search."""
    points = np.random.default_rng(0).random((256, 1)).astype(np.float32)
    means = []
    for seed in range(60):
        tree = grow(points, seed, 0)
        arrays = tuple(tree[c] for c in ("feature", "cut", "child", "path"))
        means.append(path_lengths(points, arrays).mean())
    assert np.mean(means) == pytest.approx(expected_path(256), rel=0.1)


def test_outliers_rank_on_top_and_runs_repeat(spark, cloud):
    df = frame(spark, cloud)
    options = {"trees": 40, "tree_rows": 128, "seed": 3}
    runs = []
    for parts in (1, 5):
        forest, model = isolation.fit_forest(df.repartition(parts), NAMES, **options)
        assert model.count() == 40 and model.agg(F.max("sample")).first()[0] == 128
        runs.append({r["transaction_id"]: r["score"] for r in forest.apply(df).collect()})
    assert runs[0] == runs[1]
    top = sorted(runs[0], key=runs[0].get, reverse=True)[:5]
    assert sorted(top) == [f"T{i:04d}" for i in range(5)]
    assert all(0 < s < 1 for s in runs[0].values())


def test_saved_forest_scores_a_changed_book(spark, cloud, tmp_path):
    df = frame(spark, cloud)
    forest, model = isolation.fit_forest(df, NAMES, trees=10, tree_rows=64)
    model.write.parquet(str(tmp_path / "forest"))
    again = isolation.Forest.load(spark.read.parquet(str(tmp_path / "forest")), NAMES)
    narrower = df.drop("f3")  # a feature the new book lacks counts as 0
    want = forest.apply(df.withColumn("f3", F.lit(0.0))).select("transaction_id", "score")
    got = again.apply(narrower).select("transaction_id", "score")
    assert sorted(got.collect()) == sorted(want.collect())


def test_constant_rows(spark):
    df = frame(spark, np.ones((30, 4), dtype=np.float32))
    forest, _ = isolation.fit_forest(df, NAMES, trees=5, tree_rows=16)
    assert {round(r["score"], 9) for r in forest.apply(df).collect()} == {0.5}


def test_standardised(spark, cloud):
    df = frame(spark, cloud).withColumn("f3", F.lit(4.0))
    out = isolation.standardised(df, NAMES).toPandas()
    assert out["f0"].mean() == pytest.approx(0, abs=1e-9)
    assert out["f0"].std(ddof=0) == pytest.approx(1)
    assert set(out["f3"]) == {0.0}


def brute_lof(points, k):
    points = points.astype(np.float64)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    rows = np.arange(len(points))[:, None]
    k_dist = d[rows, near][:, -1]
    reach = np.maximum(d[rows, near], k_dist[near])
    density = 1.0 / (reach.mean(1) + 1e-10)
    return density[near].mean(1) / density


@pytest.mark.parametrize("cell_points, block", [(10_000, 2_048), (60, 2_048), (25, 16)])
def test_lof_is_exact_for_any_cells_and_blocks(spark, cloud, monkeypatch, cell_points, block):
    monkeypatch.setattr(lof, "CELL_POINTS", cell_points)
    monkeypatch.setattr(lof, "BLOCK", block)
    points = cloud[:300]  # no copies: neighbours are unique
    got = lof.local_outlier_factor(frame(spark, points), NAMES, k=12).toPandas()
    want = brute_lof(points, 12)
    assert got.sort_values("transaction_id")["lof"].to_numpy() == pytest.approx(want, rel=1e-6)


def test_lof_with_many_copies(spark, cloud, monkeypatch):
    monkeypatch.setattr(lof, "CELL_POINTS", 80)
    got = lof.local_outlier_factor(frame(spark, cloud), NAMES, k=10).toPandas()
    got = got.sort_values("transaction_id")["lof"].to_numpy()
    assert len(got) == len(cloud)
    assert np.allclose(got[300:560], 1.0)  # copies are as dense as their neighbours: themselves
    assert set(np.argsort(-got)[:5]) <= set(range(300)) | set(range(560, 700))
    usual = brute_lof(cloud, 10)
    # points that do not have the copies among their neighbours agree with brute force
    alike = np.isclose(got, usual, rtol=1e-6)
    assert alike[300:560].all() and alike.mean() > 0.9


def test_fewer_points_than_neighbours(spark, cloud):
    near = lof.neighbours(lof._collapse(frame(spark, cloud[:6]).select(F.array(*NAMES).alias("x"))), 35)
    assert near.count() == 6 * 5


def test_trees_draw_from_the_whole_book(spark):
    """Far beyond 64 samples' worth of rows, a larger book still gives more different rows."""
    seen = []
    for n in (20_000, 40_000):
        rows = spark.range(n).selectExpr("concat('T', id) AS transaction_id", "CAST(id AS DOUBLE) AS f")
        drawn = isolation.samples(rows, ["f"], n, trees=100, tree_rows=64, seed=1)
        seen.append(drawn.select("x").distinct().count())
        per_tree = [r["count"] for r in drawn.groupBy("tree").count().collect()]
        assert len(per_tree) == 100 and min(per_tree) >= 64
    assert 64 * 64 < seen[0] < seen[1]


def test_rare_levels_share_a_column(spark):
    from tallyguard.operators.features import RARE, observed_levels, one_hot

    rows = spark.range(60).selectExpr(
        "CASE WHEN id < 50 THEN concat('k', id) WHEN id < 59 THEN 'k7' END AS transaction_type", "'c' AS channel"
    )
    assert len(observed_levels(rows, most=50)["transaction_type"]) == 50  # none is rare
    levels = observed_levels(rows, most=3)
    assert levels == {"transaction_type": ["k0", "k1", "k7", RARE], "channel": ["c"]}
    later = spark.createDataFrame([("k7", "c"), ("k9", "d"), ("new", "c"), (None, None)], "transaction_type string, channel string")
    got = later.select(*[e.alias(c) for c, e in one_hot(levels).items()]).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 0, 1), (0, 0, 0, 1, 0), (0, 0, 0, 1, 1), (0, 0, 0, 0, 0)]


def ml_rows(spark):
    rng = np.random.default_rng(8)
    rows = [
        (f"T{i:04d}", float(rng.normal()), float(rng.normal() * 9), rng.choice(["a", "b", None, f"odd{i}"]).__str__())
        for i in range(500)
    ]
    rows += [("X1", 40.0, -300.0, "a"), ("X2", None, 1.0, None)]
    table = spark.createDataFrame(rows, "transaction_id string, f double, g double, kind string")
    return table.withColumn("kind", F.nullif("kind", F.lit("None"))).fillna({"f": 0.0})


def test_pipeline_is_saved_and_loaded_in_another_process(spark, tmp_path):
    rows = ml_rows(spark)
    fitted = pipeline.detector_pipeline(["f", "g"], ["kind"], most=2, trees=20, treeRows=128).fit(rows)
    assert json.loads(fitted.stages[0].getOrDefault("levels")) == {"kind": ["a", "b", "<rare>"]}
    scored = {r["transaction_id"]: r["score"] for r in fitted.transform(rows).select("transaction_id", "score").collect()}
    assert len(scored) == 502 and max(scored, key=scored.get) == "X1"
    rows.write.parquet(f"{tmp_path}/rows")
    fitted.write().save(f"{tmp_path}/model")
    code = f"""
import json, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from tallyguard.session import local_session
spark = local_session(cpus=2)
from pyspark.ml import PipelineModel
model = PipelineModel.load({f"{tmp_path}/model"!r})
rows = model.transform(spark.read.parquet({f"{tmp_path}/rows"!r})).select("transaction_id", "score").collect()
print("SCORES" + json.dumps(dict(map(tuple, rows))))
"""
    env = {**os.environ, "PYSPARK_GATEWAY_PORT": "", "PYSPARK_GATEWAY_SECRET": ""}
    env = {k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=170)
    line = next(x for x in done.stdout.splitlines() if x.startswith("SCORES"))
    assert json.loads(line.removeprefix("SCORES")) == scored


def test_pipeline_on_levels_and_rows_it_has_not_seen(spark):
    rows = ml_rows(spark)
    fitted = pipeline.inputs_pipeline(["f"], ["kind"], most=500).fit(rows.filter("kind IN ('a', 'b')"))
    later = spark.createDataFrame([("n", 0.0, 0.0, "new"), ("m", 0.0, 0.0, None)], rows.schema)
    out = fitted.transform(later).select("kind_folded", "kind_index").collect()
    assert [tuple(r) for r in out] == [("new", 2.0), ("<missing>", 2.0)]
    assert fitted.transform(later.limit(0)).count() == 0


def clusters(n, dims=12, seed=5):
    """Points around a few centres of different spread."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(15, dims)) * 4
    of = rng.integers(0, 15, n)
    return centre[of] + rng.normal(size=(n, dims)) * rng.uniform(0.2, 1.5, 15)[of][:, None]


def as_points(spark, x, copies=None):
    copies = np.ones(len(x), int) if copies is None else copies
    rows = [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, copies))]
    return spark.createDataFrame(rows, "point bigint, x array<float>, copies bigint")


def found_by(near):
    out = {}
    for row in near.collect():
        out.setdefault(row["q"], []).append((row["o"], row["dist"], row["weight"]))
    return out


def test_projected_neighbours_reach_most_and_bound_their_cells(spark, monkeypatch):
    x = clusters(6000)
    points = as_points(spark, x)
    near = projection.projected_neighbours(points, 12, tables=8, leaf=200)
    got = found_by(near)
    assert len(got) == len(x) and all(sum(w for *_, w in rows) == 12 for rows in got.values())
    x = x.astype(np.float32).astype(float)
    for q in range(0, 6000, 400):  # the distances are those of the points
        for o, dist, _ in got[q]:
            assert dist == pytest.approx(np.linalg.norm(x[q] - x[o]), abs=1e-5) and o != q
    share = projection.recall(points, near, 12, queries=100)
    true = 0
    for q in range(0, 6000, 60):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        true += len(set(np.argsort(d)[:12]) & {o for o, *_ in got[q]})
    assert share >= 0.9 and abs(share - true / 1200) < 0.06
    sizes = projection._cells(points, x.shape[1], 8, 200).groupBy("table", "cell").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 400


def test_cells_are_cut_again_until_they_are_small(spark, monkeypatch):
    """Two halvings a round: later rounds cut every cell by its own medians."""
    monkeypatch.setattr(projection, "HALVINGS", 2)
    points = as_points(spark, clusters(3000, 5))
    cells = projection._cells(points, 5, 3, 50)
    assert cells.count() == 9000 and cells.select("table", "point").distinct().count() == 9000
    assert cells.groupBy("table", "cell").count().agg({"count": "max"}).first()[0] <= 100


def test_projected_neighbours_of_few_equal_or_many_copied_points(spark, monkeypatch):
    monkeypatch.setattr(projection, "BLOCK", 16)  # tiles
    x = clusters(150, 4)
    copies = np.ones(150, int)
    copies[7] = 40
    near = found_by(projection.projected_neighbours(as_points(spark, x, copies), 10, tables=2, leaf=500))
    exact = found_by(lof.neighbours(as_points(spark, x, copies), 10))
    for q, rows in exact.items():  # one cell holds all points, so nothing is missed
        assert sorted((round(d, 4), w) for _, d, w in rows) == sorted((round(d, 4), w) for _, d, w in near[q])
    assert near[7] == [(7, 0.0, 10)]
    line = as_points(spark, np.zeros((900, 3)) + np.arange(900)[:, None] // 450)  # no direction parts equal ones
    assert len(found_by(projection.projected_neighbours(line, 5, tables=2, leaf=20))) == 900
    assert projection.projected_neighbours(as_points(spark, x).limit(0), 5).count() == 0


def test_detectors_at_a_budget(spark):
    rng = np.random.default_rng(3)
    x = clusters(800, 6)
    x[:20] += rng.normal(size=(20, 6)) * 25  # planted outliers
    names = [f"f{i}" for i in range(6)]
    rows = [(f"T{i:04d}", int(i < 20), float(i % 40), *map(float, v)) for i, v in enumerate(x)]
    ddl = "transaction_id string, label int, poor double, " + ", ".join(f"{c} double" for c in names)
    table = spark.createDataFrame(rows, ddl)
    tried = {
        "poor": detectors.by_column("poor"),
        "exact": detectors.by_density(names, 20, exact=True),
        "projected": detectors.by_density(names, 20),
    }
    got = {r["detector"]: r for r in detectors.compare(table, tried, budget=40).collect()}
    top = sorted(rows, key=lambda r: (-r[2], r[0]))[:40]
    assert got["poor"]["cases_caught"] == sum(r[1] for r in top)
    assert got["exact"]["cases_caught"] >= 18 and got["projected"]["cases_caught"] >= 18
    assert {r["of"] for r in got.values()} == {20}
