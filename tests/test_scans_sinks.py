"""Scans that keep bad records, sinks that survive a rerun, the sketch, parametrised reports."""

import random

import pytest
from conftest import book_of, payment
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard import reports, workflow
from tallyguard.operators import cleaning, evidence, profiling, sketch
from tallyguard.sources import files, scan, schemas, sinks

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("day", T.DateType()),
    ]
)


@pytest.fixture()
def lines(tmp_path):
    def write(text, name="f.csv"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_bad_records_keep_their_text(spark, lines):
    path = lines(
        "id,amount,day\na,1.5,2025-01-02\nb,n/a,2025-01-02\nc,2,soon\nd,x,never\n"
        "e,3\nf,4,2025-01-02,more\ng,,\n\"h,h\",5,2025-01-02\n\n"
    )
    good, bad = scan.split(scan.scan_csv(spark, path, SCHEMA))
    assert good.schema.names == SCHEMA.names
    assert sorted(r["id"] for r in good.collect()) == ["a", "g", "h,h"]
    found = {r[scan.LINE]: r[scan.REASON] for r in bad.collect()}
    assert found == {
        "b,n/a,2025-01-02": "unreadable: amount",
        "c,2,soon": "unreadable: day",
        "d,x,never": "unreadable: amount, day",
        "e,3": scan.WRONG_COUNT,
        "f,4,2025-01-02,more": scan.WRONG_COUNT,
    }


def test_an_empty_file_has_no_rows(spark, lines):
    good, bad = scan.split(scan.scan_csv(spark, lines("id,amount,day\n"), SCHEMA))
    assert good.isEmpty() and bad.isEmpty()


def test_documents_of_any_shape(spark, lines):
    path = lines('{"id": 1, "legs": [{"a": "x"}, {"a": 2}, null]}\n{"id": "two"}\n{"legs": []}\n')
    documents = scan.read_documents(spark, path)
    ids = documents.select(*scan.fields(F.col("document"), {"id": ("$.id", "int")}))
    assert sorted([r["id"] for r in ids.collect()], key=str) == [1, None, None]
    legs = scan.elements(documents, "$.legs").select(
        "place", *scan.fields(F.col("element"), {"a": ("$.a", "string")})
    )
    assert sorted(map(tuple, legs.collect())) == [(0, "x"), (1, "2"), (2, None)]


def test_an_array_of_documents_in_one_file(spark, lines):
    documents = scan.read_documents(spark, lines('[{"n": 1},\n {"n": 2}]'), multi_line=True)
    items = scan.elements(documents, "$")
    got = items.select("place", *scan.fields(F.col("element"), {"n": ("$.n", "int")}))
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 2)]


def numbers(spark, n=100):
    return spark.range(n).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS part")


def test_a_run_is_published_once(spark, tmp_path):
    path = str(tmp_path / "t")
    total = {"total": F.sum("id")}
    first = sinks.publish(numbers(spark), path, "monday", by=("part",), metrics=total)
    again = sinks.publish(numbers(spark, 7), path, "monday", by=("part",), metrics=total)
    assert first == again and first["metrics"] == {"rows": 100, "total": 4950}
    back = sinks.read_published(spark, path, "monday")
    assert back.columns == ["id", "part"]
    assert sorted(back.collect()) == sorted(numbers(spark).collect())
    assert "PartitionFilters: [isnotnull(part" in back.filter("part = 'a'")._jdf.queryExecution().toString()
    sinks.publish(numbers(spark, 7), path, "tuesday")
    assert sinks.read_published(spark, path).count() == 7
    assert sinks.read_published(spark, path, "monday").count() == 100
    assert sinks.observed_metrics(spark, path, "monday").first().asDict() == {"rows": 100, "total": 4950}


def test_a_half_written_folder_is_never_read(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path)
    # the driver was lost: rows lie there, some without a committed job, and no manifest row
    numbers(spark, 40).write.partitionBy("part").parquet(f"{path}/data/lost")
    numbers(spark, 30).write.parquet(f"{path}/data/lost2/_temporary/0/task")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path)
    broken = numbers(spark).withColumn("id", F.when(F.col("id") < 90, F.col("id")).otherwise(
        F.raise_error(F.lit("lost")).cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, path, "monday", by=("part",))
    assert sinks.published(spark, path, "monday") is None
    sinks.publish(numbers(spark), path, "monday", by=("part",))
    assert sinks.read_published(spark, path, "monday").count() == 100


def test_two_drivers_of_one_run_agree(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(numbers(spark, 5), path, None)
    rows = [("r", "data/one", 10, "{}", {"rows": 1}), ("r", "data/two", 11, "{}", {"rows": 2})]
    spark.createDataFrame(rows, sinks.MANIFEST).write.mode("append").json(f"{path}/manifest")
    assert sinks.published(spark, path, "r")["folder"] == "data/one"


def test_empty_table_is_published(spark, tmp_path):
    path = str(tmp_path / "t")
    row = sinks.publish(numbers(spark, 0), path, "r", by=("part",), metrics=cleaning_free())
    assert row["metrics"]["rows"] == 0
    assert sinks.read_published(spark, path).isEmpty()


def cleaning_free():
    return {"total": F.coalesce(F.sum("id"), F.lit(0))}


RAW_LINES = """transaction_id,timestamp,sender_account,receiver_account,amount,currency,sender_country,receiver_country,transaction_type,channel
T1,2025-06-01 09:00:05,A,B,10.0,GBP,X,Y,transfer,app
T1,2025-06-01 09:00:05,A,B,10.0,GBP,X,Y,transfer,app
T2,2025-06-01 09:00:05,A,B,ten,GBP,X,Y,transfer,app
T3,2025-06-01 10:00:00,A
T4,2025-06-02 09:00:05,A,C,-4.0,GBP,X,Y,wire_transfer,
T5,02/06/2025 11:30,A,C,60000,GBP,,Y,transfer,app
T5,02/06/2025 12:30,A,D,,GBP,Z,Y,transfer,app
"""


def test_unreadable_lines_reach_the_quarantine(spark, lines, tmp_path):
    good, bad = scan.split(scan.scan_csv(spark, lines(RAW_LINES), schemas.RAW))
    customers = files.from_rows(spark, [{"account_id": "A", "home_country": "H"}], schemas.CUSTOMERS)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second time, everything is read
        book, rejected, log = workflow.publish_clean(good, customers, out, "r", {}, bad)
        assert sorted(r["transaction_id"] for r in book.collect()) == ["T1", "T5"]
        assert {(r["transaction_id"], r[cleaning.REASON]) for r in rejected.collect()} == {
            ("T2", "unreadable: amount"),
            ("T3", scan.WRONG_COUNT),
            ("T4", "amount_negative"),
            ("T5", "amount_missing"),
        }
        assert log.first().asDict() == {
            "rows_in": 7,
            "unparsed_timestamps": 0,
            "sender_country_imputed": 1,
            "channel_unknown": 1,
            "exact_duplicates_dropped": 1,
            "near_duplicates_dropped": 0,
            "wire_transfer_type_remapped": 1,
            "quarantined_missing_amount": 1,
            "quarantined_negative_amount": 1,
            "quarantined_unreadable": 2,
            "amount_over_50k_kept": 1,
            "rows_out": 2,
            "ids_still_duplicated": 1,
        }
    assert book.filter("transaction_id = 'T5'").first()["sender_country"] == "H"


def test_sketch_errors_and_merging(spark):
    rng = random.Random(3)
    pennies = [round(rng.lognormvariate(8, 3)) * rng.choice([1, 1, 1, -1]) for _ in range(4000)]
    rows = [(i, i % 3, p / 100) for i, p in enumerate(pennies)] + [(0, 0, None), (1, 1, float("nan"))]
    df = spark.createDataFrame(rows, "id int, day int, amount double")
    whole = sketch.sketch(df, "amount")
    parts = sketch.merged(sketch.sketch(df, "amount", ["day"]).drop("day"))
    assert sorted(whole.collect()) == sorted(parts.collect())
    ordered = sorted(pennies)
    for r in sketch.quantiles(whole, [0, 0.01, 0.25, 0.5, 0.999, 1]).collect():
        exact = ordered[r["rank"] - 1]
        assert r["rows"] == 4000 and r["low"] <= exact <= r["high"]
        assert abs(r["estimate"] - exact) <= abs(exact) / 2**sketch.BITS
        assert r["rank_from"] == 1 + sum(p < r["low"] for p in ordered)
        assert r["rank_to"] == sum(p <= r["high"] for p in ordered)
    per_day = sketch.quantiles(sketch.sketch(df, "amount", ["day"]), [0.5], ["day"])
    assert per_day.count() == 3
    assert sketch.quantiles(sketch.sketch(df.limit(0), "amount"), [0.5]).isEmpty()


def test_values_at_ranks(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 3, 3, 3]], "amount double")
    ranks = spark.createDataFrame([(1,), (2,), (3,), (6,), (7,)], "rank bigint")
    got = {r["rank"]: r["value"] for r in profiling.values_at_ranks(df, "amount", ranks).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 3.0, 6: 5.0}


def test_payload_pages(spark):
    records = spark.range(1, 24).selectExpr("printf('ALERT-%04d', id) AS id", "id AS amount")
    pages = {r["page"]: [c["amount"] for c in r["cases"]] for r in
             evidence.payload_pages(records, 10).collect()}
    assert pages == {0: list(range(1, 11)), 1: list(range(11, 21)), 2: [21, 22, 23]}


def test_report_arguments_are_values(spark):
    rows = [payment(i, hours=i, sender="O'A" if i % 2 else "B", amount=6000.0 + i) for i in range(8)]
    reports.register(spark, book_of(spark, rows), spark.createDataFrame([], schemas.CUSTOMERS))
    reports.define(spark)
    got = reports.call(spark, "payments_in_band", threshold=6006.0, low=0.5, times=3).collect()
    assert {r["sender_account"]: r["payments"] for r in got} == {"O'A": 3, "B": 3}
    none = F.array(F.lit("') OR true --"))
    assert reports.call(spark, "country_exposure", countries=none, at_least=0.0).isEmpty()
    again = spark.sql("SELECT sum(payments) FROM payments_in_band(7000D, 0.1D, 1L)").first()[0]
    assert again == 8
