import datetime as dt
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyguard.operators.cleaning import with_derived
from tallyguard.operators.rules import with_clock
from tallyguard.session import local_session

START = dt.datetime(2025, 6, 1, 9, 0, 0)
COLUMNS = (
    "transaction_id string, timestamp timestamp, sender_account string, receiver_account string, "
    "amount double, currency string, sender_country string, receiver_country string, "
    "transaction_type string, channel string"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, name="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


def payment(
    i,
    hours=0.0,
    sender="ACC1",
    receiver="ACC2",
    amount=100.0,
    countries=("United Kingdom", "United Kingdom"),
    kind="transfer",
    channel="online_transfer",
):
    at = START + dt.timedelta(hours=hours)
    return (f"T{i:05d}", at, sender, receiver, amount, "GBP", *countries, kind, channel)


def book_of(spark, rows):
    return with_clock(with_derived(spark.createDataFrame(rows, COLUMNS)))


def skewed_rows(n=600, seed=5):
    """A third of all legs on one account, repeated instants, equal amounts, self-payments."""
    rng = random.Random(seed)

    def account():
        return "HOT" if rng.random() < 0.34 else f"A{rng.randrange(12)}"

    rows = []
    for i in range(n):
        # half of the times on a coarse grid, so that instants repeat
        hours = rng.randrange(0, 60 * 24, 6) if rng.random() < 0.5 else rng.uniform(0, 60 * 24)
        amount = rng.choice([7000.0, 8500.5, 9999.99, 1200.0, 6400.25, round(rng.uniform(1, 12000), 2)])
        rows.append(payment(i, hours, account(), account(), amount))
    return rows


@pytest.fixture(scope="session")
def skewed(spark):
    book = book_of(spark, skewed_rows())
    book = spark.createDataFrame(book.collect(), book.schema)
    return book


def ids(df):
    return sorted(r["transaction_id"] for r in df.collect())
