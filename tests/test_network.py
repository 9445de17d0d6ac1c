"""Partners in chains without pairs, against the pairs."""

import datetime as dt
import random

import pytest
from conftest import COLUMNS, START, book_of, payment, skewed_rows
from pyspark.sql import functions as F

from tallyguard.operators import network
from tallyguard.plans import count_in_ranges


def partners(book, **how):
    found = network.with_partners(book, **how).collect()
    return {
        r["transaction_id"]: (r["passed_on"], r["next_hop"], r["fed_by"], r["previous_hop"], r["in_chain"])
        for r in found
    }


def brute(rows, min_amount=1000, hours=24, percent=15):
    """All pairs, by the definition."""
    big = [(r[0], r[1], r[2], r[3], round(r[4] * 100)) for r in rows if r[4] is not None and r[4] >= min_amount]
    on = {r[0]: [] for r in rows}
    fed = {r[0]: [] for r in rows}
    for i, at, _, via, a in big:
        for o, then, sender, _, b in big:
            if sender == via is not None and dt.timedelta(0) < then - at <= dt.timedelta(hours=hours):
                if abs(b - a) * 100 <= a * percent:
                    on[i].append((then, o))
                    fed[o].append((START - at, i))
    pick = lambda found: (len(found), min(found)[1] if found else None)
    return {r[0]: (*pick(on[r[0]]), *pick(fed[r[0]]), bool(on[r[0]] or fed[r[0]])) for r in rows}


def test_partners_against_all_pairs(spark):
    rows = skewed_rows(700, seed=11)
    assert partners(book_of(spark, rows)) == brute(rows)


def test_dense_account(spark):
    """One account with many payments of an hour, equal amounts and equal instants."""
    rng = random.Random(4)
    rows = []
    for i in range(500):
        ends = ("HUB", f"B{rng.randrange(3)}") if rng.random() < 0.5 else (f"B{rng.randrange(3)}", "HUB")
        amount = rng.choice([5000.0, 5000.0, 5750.0, 4250.01, 5000.01, round(rng.uniform(4000, 7000), 2)])
        rows.append(payment(i, rng.randrange(60) / 10, *ends, amount))
    rows += [payment(600 + i, 1.5, "HUB", "HUB", 5000.0) for i in range(4)]  # to itself
    assert partners(book_of(spark, rows)) == brute(rows)


@pytest.mark.parametrize(
    "hours, amount, met",
    [(24.0, 1000.0, 1), (24.0 + 1e-5, 1000.0, 0), (0.0, 1000.0, 0), (1.0, 1150.0, 1), (1.0, 1150.01, 0), (1.0, 850.0, 1), (1.0, 849.99, 0)],
)
def test_limits(spark, hours, amount, met):
    rows = [payment(1, 0, "A", "B", 1000.0), payment(2, hours, "B", "C", amount)]
    got = partners(book_of(spark, rows), min_amount=100)
    assert got["T00001"][0] == met and got["T00002"][2] == met
    assert got == brute(rows, min_amount=100)


def test_nulls_and_small_sums(spark):
    rows = [
        payment(1, 0, "A", None, 2000.0),
        payment(2, 1, None, "C", 2000.0),
        payment(3, 0, "A", "B", None),
        payment(4, 1, "B", "C", 999.99),
    ]
    rows.append((*rows[0][:1], None, "B", "B", 3000.0, *rows[0][5:]))
    book = spark.createDataFrame(rows[1:], COLUMNS).withColumn("us", F.unix_micros("timestamp"))
    assert set(partners(book).values()) == {(0, None, 0, None, False)}
    assert partners(book.limit(0)) == {}


def test_hundred_thousand_equal_payments_of_one_account(spark):
    """1.25 billion pairs, none of them made: rows stay those of payments times a logarithm."""
    n = 50_000
    legs = spark.range(2 * n).select(
        F.format_string("T%06d", "id").alias("transaction_id"),
        (F.lit(START) + F.make_interval(secs=F.floor(F.col("id") / 2))).alias("timestamp"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("HUB").alias("sender_account"),
        F.when(F.col("id") % 2 == 0, "HUB").otherwise("Z").alias("receiver_account"),
        F.lit(5000.0).alias("amount"),
    )
    found = network.with_partners(legs, window_hours=10)  # 36,000 seconds
    k = F.floor(F.substring("transaction_id", 2, 6).cast("int") / 2)
    later = F.least(F.lit(n - 1) - k, F.lit(36_000))
    earlier = F.least(k, F.lit(36_000))
    even = F.substring("transaction_id", 2, 6).cast("int") % 2 == 0
    wrong = found.filter(
        (F.col("passed_on") != F.when(even, later).otherwise(0))
        | (F.col("fed_by") != F.when(even, 0).otherwise(earlier))
        | (F.col("next_hop") != F.format_string("T%06d", 2 * k + 3))
        | (F.col("previous_hop") != F.format_string("T%06d", 2 * k - 2))
    )
    assert wrong.count() == 0
    assert found.agg(F.sum("passed_on")).first()[0] == sum(min(n - 1 - i, 36_000) for i in range(n))


def test_many_copies_are_one_point(spark):
    queries = spark.range(3).select(F.lit("k").alias("key"), F.lit(0).cast("long").alias("us"), F.lit(1).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi"))
    points = spark.range(20_000).select(F.lit("k").alias("key"), F.lit(5).cast("long").alias("us"), F.lit(4).cast("long").alias("value"), F.col("id").cast("string").alias("id"))
    (row,) = count_in_ranges(queries, points, 10).collect()
    assert (row["met"], row["first"]["us"], row["first"]["id"]) == (20_000, 5, "0")
