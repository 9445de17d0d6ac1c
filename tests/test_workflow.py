"""Files in, files out: readers, sinks, the whole run and the SQL reports."""

import datetime as dt
import json

import pytest
from conftest import book_of, ids, payment
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyguard import reports, workflow
from tallyguard.operators import rules
from tallyguard.plans import clear, stage
from tallyguard.plans.stage import stage_root
from tallyguard.sources import files, schemas, testbook

FOLDER = "/root/testdata/sf0.001"
PARAMS = {
    "structuring": {"band_low": 0.60},
    "rapid_movement": {"min_amount": 6_000},
    "high_risk_country": {"countries": testbook.HIGH_RISK},
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    files.write_table(testbook.raw_text(spark, FOLDER), f"{folder}/raw", "csv")
    files.write_table(testbook.customers(spark, FOLDER), f"{folder}/customers", "csv")
    files.write_table(testbook.labels(spark, FOLDER), f"{folder}/labels", "csv")
    return str(folder)


def test_csv_readers(spark, feed):
    raw = files.read_raw(spark, f"{feed}/raw")
    text = files.read_raw_text(spark, f"{feed}/raw")
    assert raw.schema == schemas.RAW and text.schema == schemas.RAW_TEXT
    assert raw.count() == text.count() == 1003
    assert raw.filter("amount IS NULL").count() == 1
    assert raw.filter("channel IS NULL").count() == 20
    assert files.read_customers(spark, f"{feed}/customers").filter(
        "account_open_date IS NULL"
    ).isEmpty()


def test_leading_blanks_survive_csv(spark, feed):
    raw = files.read_raw_text(spark, f"{feed}/raw")
    assert raw.filter(F.col("sender_country").startswith(" ")).count() > 0


def test_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"scenario": "a", "n": 1}, {"scenario": "b", "n": 2}]))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("scenario", T.StringType()), T.StructField("n", T.LongType())])
    got = files.read_json_document(spark, str(tmp_path / "d.json"), schema)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]


def test_clean_csv_round_trip(spark, tmp_path):
    book = book_of(spark, [payment(0, 5.5), payment(1, 30, amount=12.34)]).drop("us")
    files.write_table(book, str(tmp_path / "clean"), "csv")
    back = files.read_clean(spark, str(tmp_path / "clean"))
    assert sorted(map(tuple, back.collect())) == sorted(
        map(tuple, book.select(*back.columns).collect())
    )


class _Session:
    """Stands in for sessions of other clusters: only the settings are asked for."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_stage_folder():
    assert stage_root(_Session("yarn", "hdfs://shared/stage/")) == "hdfs://shared/stage"
    assert stage_root(_Session("local[2]", "/shared")) == "/shared"
    own = stage_root(_Session("local[2]"))
    assert own and stage_root(_Session("local[2]")) == own
    with pytest.raises(RuntimeError):
        stage_root(_Session("spark://host:7077"))


def test_stage_keeps_rows_and_schema(spark):
    book = book_of(spark, [payment(0), payment(1, 3)])
    staged = stage(book, "t")
    assert staged.dtypes == book.dtypes and sorted(staged.collect()) == sorted(book.collect())


@pytest.fixture(scope="module")
def finished(spark, feed, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run") / "out")
    tables = workflow.run(
        files.read_raw_text(spark, f"{feed}/raw"),
        files.read_raw(spark, f"{feed}/raw"),
        files.read_customers(spark, f"{feed}/customers"),
        files.read_labels(spark, f"{feed}/labels"),
        out,
        testbook.SPELLINGS,
        PARAMS,
        trees=30,
        tree_rows=256,
    )
    return out, tables


def test_whole_run(spark, finished):
    out, tables = finished
    log = spark.read.json(f"{out}/cleaning_log").first()
    assert (log["rows_in"], log["exact_duplicates_dropped"], log["near_duplicates_dropped"]) == (
        1003,
        2,
        1,
    )
    assert spark.read.parquet(f"{out}/transactions_clean").count() == log["rows_out"]
    assert spark.read.parquet(f"{out}/quarantined_rows").count() == 2
    strategies = {r["strategy"]: r for r in spark.read.json(f"{out}/strategies").collect()}
    cases = spark.read.parquet(f"{out}/case_list")
    assert cases.count() == strategies["combined_final"]["alerts"] > 0
    assert cases.filter("alert_ref = 'ALERT-0001'").count() == 1
    assert "transaction_id" not in cases.columns
    payload = spark.read.json(f"{out}/payload").collect()
    assert len(payload) == cases.count()
    for record in payload:
        assert len(record["evidence"]) == len(record["reasons"]) > 0
        assert not any("TXN" in line for line in record["evidence"])
    profile = spark.read.json(f"{out}/profile/missing")
    assert {r["column"] for r in profile.collect()} == {"amount", "sender_country", "channel"}


def test_payload_follows_the_queue(finished):
    _, tables = finished
    rows = tables["queue"].orderBy("position").select("anomaly_pct", "position").collect()
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))
    pcts = [r["anomaly_pct"] for r in rows]
    assert pcts == sorted(pcts, reverse=True)


def test_reports(spark):
    rows = [
        payment(0, 0, "S0", "X", 9500.0),
        payment(1, 24, "S1", "X", 9500.5, ("Panama", "Malta")),
        payment(2, 48, "S2", "X", 9500.0, ("France", "Malta")),
        payment(3, 50, "X", "OUT", 9400.5),
        payment(4, 900, "Q", "Z", 50.0),
    ]
    book = book_of(spark, rows)
    people = spark.createDataFrame([("X", "France", dt.date(2020, 1, 1))], schemas.CUSTOMERS)
    spark.catalog.dropTempView("labels")
    reports.register(spark, book, people)
    assert ids(reports.run(spark, "structuring")) == ids(rules.structuring(book))
    assert ids(reports.run(spark, "rapid_movement")) == ids(rules.rapid_movement(book))
    found = {r["transaction_id"]: r["exposure"] for r in reports.run(spark, "high_risk_country").collect()}
    assert found == {"T00001": "both legs", "T00002": "receiver"}
    with pytest.raises(AnalysisException):  # detection ran without labels, measurement needs them
        reports.run(spark, "rule_contribution").collect()
    marks = spark.createDataFrame([("T00001", 1), ("T00001", 1), ("T00003", 1)], schemas.LABELS)
    reports.register(spark, book, people, marks)
    rows = {r["rule"]: r for r in reports.run(spark, "rule_contribution").collect()}
    assert rows["structuring"]["alerts"] == 3
    assert rows["rapid_movement"]["cases_no_other_rule_found"] == 1
    assert set(reports.run_all(spark)) == set(reports.REPORTS)


def test_features_ignore_ids_and_countries(spark):
    from tallyguard.operators import features

    names = features.feature_names({"transaction_type": ["a"], "channel": ["b"]})
    assert len(features.NUMERIC) == 16
    assert not [n for n in names if "country" in n or "transaction_id" in n]


def test_unknown_account_age_is_the_median(spark):
    from tallyguard.operators import features

    book = book_of(spark, [payment(i, 0, sender=f"S{i}") for i in range(4)])
    people = spark.createDataFrame(
        [(f"S{i}", "X", dt.date(2025, 5, d)) for i, d in enumerate((1, 2, 12))], schemas.CUSTOMERS
    )
    got = features.with_tenure(book, people).orderBy("transaction_id").collect()
    assert [r["sender_account_age_days"] for r in got] == [31.0, 30.0, 20.0, 30.0]


def test_unseen_category_gives_zeros(spark):
    from tallyguard.operators import features

    book = book_of(spark, [payment(0, kind="novel")])
    cols = features.one_hot({"transaction_type": ["payment", "transfer"], "channel": ["online_transfer"]})
    row = book.select(*[c.alias(n) for n, c in cols.items()]).first()
    assert list(row) == [0.0, 0.0, 1.0]


def test_saved_model_scores_alone(spark, finished):
    from tallyguard.operators import features, isolation, rules

    out, tables = finished
    forest, levels = isolation.load_model(spark, f"{out}/forest")
    assert forest.names == features.feature_names(levels)
    people = spark.createDataFrame([("ACC000001", "X", dt.date(2020, 1, 1))], schemas.CUSTOMERS)
    book = rules.with_row_key(book_of(spark, [payment(i, i) for i in range(5)]))
    matrix = features.build_features(book, people, levels, keep=(rules.ROW,))
    scores = [r["score"] for r in forest.apply(matrix).collect()]
    assert len(scores) == 5 and all(0 < s < 1 for s in scores)


def test_reports_and_scored_book_are_written(spark, finished):
    out, tables = finished
    report = spark.read.json(f"{out}/metrics_report").first()
    assert {r["strategy"] for r in report["strategies"]} >= {"any_rule", "combined_final"}
    assert len(report["network_summary"]) == len(report["headline"]) == 1
    scored = spark.read.parquet(f"{out}/transactions_scored")
    book = spark.read.parquet(f"{out}/transactions_clean")
    assert scored.count() == book.count()
    assert {"score", "label", "rule_alert", "final_alert"} <= set(scored.columns)


def test_repeated_ids_stay_rows(spark):
    from tallyguard.operators import evaluation, rules

    rows = [payment(1, 0, "A", "B", 5000.0), payment(1, 1, "C", "D", 70.5), payment(2, 2)]
    book = rules.with_row_key(book_of(spark, rows))
    scores = book.select("row_key", F.col("amount").alias("score"))
    joined = evaluation.with_scores(rules.apply_all(book), scores).collect()
    assert sorted((r["transaction_id"], r["score"]) for r in joined) == sorted(
        (r[0], r[4]) for r in rows
    )


def test_clear_removes_staged_tables(spark, tmp_path):
    """Of one application only; the session stands in for one with another folder."""
    real = spark.sparkContext
    other = {"master": "local", "applicationId": "app-1", "_jvm": real._jvm, "_jsc": real._jsc}
    session = _Session("local", str(tmp_path))
    session.sparkContext = type("Context", (), other)()
    for app in ("app-1", "app-2"):
        spark.range(3).write.parquet(f"{tmp_path}/tallyguard-{app}/t")
    clear(session)
    assert [p.name for p in tmp_path.iterdir()] == ["tallyguard-app-2"]
