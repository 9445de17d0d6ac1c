"""Parsing, folding, replays and quarantine on hand-made feeds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyguard.functions.text import folded
from tallyguard.functions.timestamps import parse_timestamp
from tallyguard.operators import cleaning
from tallyguard.plans import HotKeys
from tallyguard.sources import schemas
from tallyguard.sources.files import from_rows


@pytest.mark.parametrize(
    "text, parsed",
    [
        ("2025-03-08 10:40:21", dt.datetime(2025, 3, 8, 10, 40, 21)),
        ("30/04/2025 00:13", dt.datetime(2025, 4, 30, 0, 13)),
        ("03/04/2025 09:00", dt.datetime(2025, 4, 3, 9, 0)),
        (" 03/04/2025 09:00\t", dt.datetime(2025, 4, 3, 9, 0)),
        ("not a date", None),
        ("2025-13-01 00:00:00", None),
        ("13/13/2025 00:00", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, parsed):
    df = spark.createDataFrame([(text,)], "t string")
    out = df.select(F.date_format(parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert out == (parsed.strftime("%Y-%m-%d %H:%M:%S") if parsed else None)


@pytest.mark.parametrize(
    "text, name",
    [
        ("USA", "United States"),
        (" u.k. ", "United Kingdom"),
        ("United kingdom", "United Kingdom"),
        ("\tGB", "United Kingdom"),
        (" France ", "France"),
        ("germany", "germany"),
        (None, None),
    ],
)
def test_countries(spark, text, name):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(folded(F.col("c"), cleaning.COUNTRY_SPELLINGS)).first()[0] == name


BASE = {
    "transaction_id": "T1",
    "timestamp": "2025-03-08 10:40:21",
    "sender_account": "A",
    "receiver_account": "B",
    "amount": 10.0,
    "currency": "GBP",
    "sender_country": "uk",
    "receiver_country": "USA",
    "transaction_type": "payment",
    "channel": "card",
}


def run(spark, *rows):
    raw = from_rows(spark, [{**BASE, **r} for r in rows], schemas.RAW)
    customers = from_rows(
        spark,
        [{"account_id": "A", "home_country": "France", "account_open_date": dt.date(2020, 1, 1)}],
        schemas.CUSTOMERS,
    )
    trace = cleaning.traced(raw, customers)
    return (
        cleaning.clean_book(trace).orderBy("transaction_id").collect(),
        cleaning.quarantine(trace).orderBy("transaction_id").collect(),
        cleaning.cleaning_log(trace).first().asDict(),
    )


def test_exact_replay_in_two_formats(spark):
    rows, _, log = run(
        spark,
        {"timestamp": "2025-03-08 10:40:00"},
        {"timestamp": "08/03/2025 10:40", "sender_country": "United Kingdom"},
    )
    assert len(rows) == 1 and log["exact_duplicates_dropped"] == 1 and log["rows_in"] == 2


def test_near_replay_keeps_the_precise_row(spark):
    rows, _, log = run(spark, {"timestamp": "08/03/2025 10:40", "transaction_id": "T0"}, {})
    assert len(rows) == 1 and log["near_duplicates_dropped"] == 1
    assert rows[0]["transaction_id"] == "T1" and rows[0]["timestamp"].second == 21


def test_replays_are_compared_before_types_are_folded(spark):
    rows, _, log = run(
        spark, {"transaction_type": "wire_transfer"}, {"transaction_type": "transfer", "channel": None}
    )
    assert [r["transaction_type"] for r in rows] == ["transfer", "transfer"]
    assert log["wire_transfer_type_remapped"] == 1 and log["ids_still_duplicated"] == 1
    assert log["channel_unknown"] == 1 and {r["channel"] for r in rows} == {"card", "unknown"}


def test_channel_of_the_stray_name_is_kept(spark):
    rows, _, _ = run(spark, {"channel": "wire_transfer"})
    assert rows[0]["channel"] == "wire_transfer"


def test_quarantine(spark):
    rows, rejected, log = run(
        spark,
        {"transaction_id": "T1", "amount": None},
        {"transaction_id": "T2", "amount": -5.0},
        {"transaction_id": "T3", "amount": 0.0},
        {"transaction_id": "T4", "amount": 60_000.0},
    )
    assert [r["transaction_id"] for r in rows] == ["T3", "T4"]
    assert [r["quarantine_reason"] for r in rejected] == ["amount_missing", "amount_negative"]
    assert log["amount_over_50k_kept"] == 1 and log["rows_out"] == 2


def test_missing_sender_country_comes_from_the_customer_file(spark):
    rows, _, log = run(
        spark,
        {"transaction_id": "T1", "sender_country": None},
        {"transaction_id": "T2", "receiver_country": None, "amount": 11.0},
        {"transaction_id": "T3", "sender_country": None, "sender_account": "Z"},
    )
    assert [r["sender_country"] for r in rows] == ["France", "United Kingdom", None]
    assert rows[1]["receiver_country"] is None
    assert log["sender_country_imputed"] == 2


def test_unreadable_time_stays_in_the_book(spark):
    rows, _, log = run(spark, {"timestamp": "soon"})
    assert rows[0]["timestamp"] is None and log["unparsed_timestamps"] == 1


def test_many_copies_and_a_salted_lookup(spark):
    raw = from_rows(spark, [BASE] * 50 + [{**BASE, "sender_country": None}] * 70, schemas.RAW)
    customers = from_rows(
        spark, [{"account_id": "A", "home_country": "France"}], schemas.CUSTOMERS
    )
    hot = HotKeys(spark.createDataFrame([("A", 7)], "_hot_key string, _parts bigint"))
    log = cleaning.cleaning_log(cleaning.traced(raw, customers, hot=hot)).first()
    assert log["rows_in"] == 120 and log["sender_country_imputed"] == 70
    assert log["exact_duplicates_dropped"] == 118 and log["near_duplicates_dropped"] == 1
    assert log["rows_out"] == 1


def test_nan_amount_is_a_missing_amount(spark):
    rows, rejected, log = run(spark, {"amount": float("nan")})
    assert rows == [] and [r["quarantine_reason"] for r in rejected] == ["amount_missing"]
    assert log["quarantined_missing_amount"] == 1 and log["amount_over_50k_kept"] == 0


def test_what_all_rows_of_a_stray_level_share(spark):
    from tallyguard.operators.profiling import level_leak

    rows = [
        ("TXN1", "wire", "UK", "UK", "app"),
        ("TXN2", "wire", "UK", None, None),
        ("ODD3", "card", "UK", "FR", "app"),
    ]
    ddl = "transaction_id string, transaction_type string, sender_country string, receiver_country string, channel string"
    raw = spark.createDataFrame(rows, ddl)
    assert tuple(level_leak(raw, "transaction_type", "wire").first()) == (2, True, False, True, False)
    assert tuple(level_leak(raw, "transaction_type", "card").first()) == (1, True, False, False, True)
    assert tuple(level_leak(raw, "transaction_type", "none").first()) == (0, None, None, None, None)
