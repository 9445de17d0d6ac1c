"""A busy account whose rows share one instant: timelines are cut inside it."""

import random

import pytest
from conftest import START, book_of, ids, payment
from pyspark.sql import functions as F

from tallyguard.operators import features, rules
from tallyguard.plans import HotKeys, find_hot, running
from tallyguard.plans.skew import CHUNK, CROWDED

TARGET = 25


@pytest.fixture(scope="module")
def dated(spark):
    """Dates without a clock: most of the busy account's payments lie on one day, some on others."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        day = 3 if rng.random() < 0.7 else rng.randrange(12)
        ends = [rng.choice(["HOT", f"A{rng.randrange(8)}"]), rng.choice(["HOT", f"A{rng.randrange(8)}"])]
        rows.append(payment(i, 24 * day, *ends, rng.choice([7000.0, 8500.5, 9999.99, 1200.0, 6400.25])))
    book = book_of(spark, rows)
    return spark.createDataFrame(book.collect(), book.schema)


@pytest.fixture(scope="module")
def hot(dated):
    found = find_hot(dated, rows=TARGET)
    assert found and found.rows == TARGET
    return found


def legs(book):
    return rules.by_side(book, ("transaction_id", "us", "amount"))


@pytest.mark.parametrize("backwards", [False, True])
def test_chunks_inside_an_instant_are_small_and_in_order(dated, hot, backwards):
    order = ["us", "transaction_id"]
    by_time = hot.split(legs(dated)).groupBy("side", "account", CHUNK).count()
    assert by_time.filter(f"{CHUNK} >= 0").agg(F.max("count")).first()[0] > 150  # not by time alone
    cut = hot.split_in_order(legs(dated), ["side", "account"], order, backwards)
    sizes = cut.filter(f"{CHUNK} >= 0").groupBy("side", "account", CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= CROWDED * TARGET
    assert sizes.agg(F.sum("count")).first()[0] == cut.filter(f"{CHUNK} >= 0").count()
    sign = -1 if backwards else 1
    for side in ("sender", "receiver"):
        seen = [tuple(r) for r in cut.filter(f"account = 'HOT' AND side = '{side}'").select(*order, CHUNK).collect()]
        seen.sort(key=lambda r: (sign * r[0], r[1]))
        numbers = [sign * r[2] for r in seen]
        assert numbers == sorted(numbers) and len(set(numbers)) > 10


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("include_self", [False, True])
def test_running_totals(dated, hot, backwards, include_self):
    timeline = legs(dated).withColumn("cents", (F.col("amount") * 100).cast("bigint"))
    totals = {"total": ("sum", "cents"), "top": ("max", "cents"), "low": ("min", "cents")}
    how = (["side", "account"], ["us", "transaction_id"], totals)
    out = [
        sorted(map(tuple, running(timeline, *how, h, include_self, backwards).collect()))
        for h in (HotKeys(), hot)
    ]
    assert out[0] == out[1] and len(out[0]) == 1800


@pytest.mark.parametrize("k", [2, 3, 5])
def test_structuring(dated, hot, k):
    plain = rules.structuring(dated, min_count=k, hot=HotKeys())
    assert ids(rules.structuring(dated, min_count=k, hot=hot)) == ids(plain) != []


def test_rapid_movement(dated, hot):
    plain = ids(rules.rapid_movement(dated, window_hours=48, hot=HotKeys()))
    assert ids(rules.rapid_movement(dated, window_hours=48, hot=hot)) == plain != []


def test_features(spark, dated, hot):
    customers = spark.createDataFrame(
        [("HOT", "United Kingdom", START.date())], "account_id string, home_country string, account_open_date date"
    )
    levels = features.observed_levels(dated)
    tables = [
        sorted(map(tuple, features.build_features(dated, customers, levels, h).collect())) for h in (HotKeys(), hot)
    ]
    assert tables[0] == tables[1] and len(tables[0]) == 900
