"""Operators on a book where one account holds a third of all legs.

Each is run on the plain path and on the split path and compared with brute force.
"""

import pytest
from conftest import book_of, ids, payment, skewed_rows
from pyspark.sql import functions as F

from tallyguard.config import DAY, HOUR
from tallyguard.operators import evidence, features, network, rules, whatif
from tallyguard.plans import HotKeys, find_hot, running
from tallyguard.plans.skew import CHUNK


@pytest.fixture(scope="module")
def hot(skewed):
    found = find_hot(skewed, rows=20)
    cuts = {r["_hot_key"]: r["_cuts"] for r in found.levels[0].collect()}
    assert len(cuts["HOT"]) > 10
    return found


@pytest.fixture(scope="module")
def rows(skewed):
    return [r.asDict() for r in skewed.collect()]


@pytest.fixture(scope="module")
def fine(skewed):
    """Boundaries of several levels, as a very busy account has them."""
    found = find_hot(skewed, rows=10, fan=3)
    assert len(found.levels) > 2
    return found


@pytest.fixture(params=["plain", "split", "fine"])
def plan(request, hot):
    if request.param == "plain":
        return HotKeys()
    if request.param == "split":
        return hot
    return request.getfixturevalue("fine")


def test_hot_accounts_are_few_and_found(skewed, hot):
    assert not find_hot(skewed)  # far below the default size
    busy = skewed.selectExpr("explode(array(sender_account, receiver_account)) AS a").groupBy("a").count()
    assert hot.keys.count() == busy.filter("count > 20").count()


def test_chunks_grow_with_time(skewed, hot):
    timeline = hot.split(skewed.withColumn("account", F.col("sender_account")))
    seen = timeline.filter("account = 'HOT'").orderBy("us").select(CHUNK).collect()
    numbers = [r[0] for r in seen]
    assert numbers == sorted(numbers) and len(set(numbers)) > 10
    assert max(numbers.count(c) for c in set(numbers)) < len(numbers) / 5
    cold = timeline.filter("account = 'A1' ").select(CHUNK).distinct().collect()
    assert len(cold) >= 1


def in_band(r):
    return 7000 <= r["amount"] < 10000


def brute_structuring(rows, k=3, width=7 * DAY):
    found = set()
    for side in ("sender_account", "receiver_account"):
        near = [r for r in rows if in_band(r)]
        for a in near:
            times = [r["us"] for r in near if r[side] == a[side]]
            for start in times:
                inside = [t for t in times if start <= t <= start + width]
                if len(inside) >= k and start <= a["us"] <= start + width:
                    found.add(a["transaction_id"])
    return sorted(found)


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_structuring(skewed, rows, plan, k):
    got = ids(rules.structuring(skewed, min_count=k, hot=plan))
    assert got == brute_structuring(rows, k)


def brute_rapid(rows, floor=1000, width=24 * HOUR):
    found = set()
    for c in rows:
        if c["amount"] < floor:
            continue
        out = [
            d
            for d in rows
            if d["sender_account"] == c["receiver_account"] and c["us"] < d["us"] <= c["us"] + width
        ]
        if out and sum(round(d["amount"] * 100) for d in out) * 10 >= 8 * round(c["amount"] * 100):
            found |= {c["transaction_id"], *(d["transaction_id"] for d in out)}
    return sorted(found)


@pytest.mark.parametrize("floor", [1000, 8000])
def test_rapid_movement(skewed, rows, plan, floor):
    got = ids(rules.rapid_movement(skewed, min_amount=floor, hot=plan))
    assert got == brute_rapid(rows, floor)


def test_history(skewed, rows, plan):
    sent = features.history(
        skewed,
        "sender",
        plan,
        {"v24": 24, "v7d": 168},
        count="n",
        distinct="met",
        amounts=True,
    )
    got = {r["transaction_id"]: r for r in sent.collect()}
    assert len(got) == len(rows)
    for a in rows:
        past = [
            b
            for b in rows
            if b["sender_account"] == a["sender_account"]
            and (b["us"], b["transaction_id"]) < (a["us"], a["transaction_id"])
        ]
        g = got[a["transaction_id"]]
        assert g["n"] == len(past) == g["past_count"]
        assert g["v24"] == sum(b["us"] >= a["us"] - 24 * HOUR for b in past)
        assert g["v7d"] == sum(b["us"] >= a["us"] - 7 * DAY for b in past)
        assert g["met"] == len({b["receiver_account"] for b in past})
        pennies = [round(b["amount"] * 100) for b in past]
        assert (g["past_cents"] or 0) == sum(pennies)
        assert int(g["past_squares"] or 0) == sum(p * p for p in pennies)
        assert (g["past_max"] or 0) == max(pennies, default=0)


def test_structuring_evidence(skewed, rows, plan):
    near = [r for r in rows if in_band(r)]
    alerts = skewed.filter("amount >= 7000 AND amount < 10000")
    got = {
        r["transaction_id"]: r
        for r in evidence.structuring_evidence(alerts, skewed, hot=plan).collect()
    }
    assert len(got) == len(near)
    for a in near:
        around = [b for b in near if abs(b["us"] - a["us"]) <= 7 * DAY]
        into = [b for b in around if b["receiver_account"] == a["receiver_account"]]
        out = [b for b in around if b["sender_account"] == a["sender_account"]]
        shape, cluster = ("into", into) if len(into) >= len(out) else ("out of", out)
        g = got[a["transaction_id"]]
        assert (g["shape"], g["payments"]) == (shape, len(cluster))
        assert g["senders"] == len({b["sender_account"] for b in cluster})
        assert g["low"] == min(b["amount"] for b in cluster)
        assert g["high"] == max(b["amount"] for b in cluster)


def test_credits_and_debits(skewed, rows, plan):
    came = {r["transaction_id"]: r for r in evidence.credits_before(skewed, skewed, hot=plan).collect()}
    went = {r["transaction_id"]: r for r in evidence.debits_after(skewed, skewed, hot=plan).collect()}
    width = 24 * HOUR
    for a in rows:
        credits = [
            c
            for c in rows
            if c["receiver_account"] == a["sender_account"]
            and c["amount"] >= 1000
            and a["us"] - width <= c["us"] <= a["us"]
        ]
        g = came.get(a["transaction_id"])
        assert (g is None) == (not credits)
        if credits:
            best = max(credits, key=lambda c: (round(c["amount"] * 100), c["us"], c["transaction_id"]))
            assert g["largest"]["id"] == best["transaction_id"]
            assert g["latest_us"] == max(c["us"] for c in credits)
        debits = [
            d
            for d in rows
            if d["sender_account"] == a["receiver_account"] and a["us"] < d["us"] <= a["us"] + width
        ]
        h = went.get(a["transaction_id"])
        assert (h is None) == (not debits)
        if debits:
            assert h["debits"] == len(debits)
            assert h["debit_cents"] == sum(round(d["amount"] * 100) for d in debits)
            assert h["last_debit_us"] == max(d["us"] for d in debits)


def test_backward_totals(skewed, rows, plan):
    timeline = skewed.select(
        F.col("sender_account").alias("account"), "us", "transaction_id", F.lit(1).alias("one")
    )
    got = running(
        timeline, ["account"], ["us", "transaction_id"], {"n": ("sum", "one")}, plan, backwards=True
    )
    for r in got.collect():
        later = [
            b
            for b in rows
            if b["sender_account"] == r["account"]
            and (b["us"] > r["us"] or (b["us"] == r["us"] and b["transaction_id"] <= r["transaction_id"]))
        ]
        assert r["n"] == len(later)


def test_chains(skewed, rows):
    got = sorted((r["hop_in"], r["hop_out"]) for r in network.chains(skewed).collect())
    want = sorted(
        (a["transaction_id"], b["transaction_id"])
        for a in rows
        for b in rows
        if a["receiver_account"] == b["sender_account"]
        and min(a["amount"], b["amount"]) >= 1000
        and 0 < b["us"] - a["us"] <= 24 * HOUR
        and 100 * abs(round(b["amount"] * 100) - round(a["amount"] * 100))
        <= 15 * round(a["amount"] * 100)
    )
    assert got == want and got


def test_chain_amount_limits(spark):
    rows = [payment(0, 0, "A", "B", 1000.0)]
    for i, amount in enumerate([850.0, 849.99, 1150.0, 1150.01, 1000.0], start=1):
        rows.append(payment(i, 5, "B", "C", amount))
    rows.append(payment(9, 24, "B", "C", 1000.0))
    rows.append(payment(10, 24.001, "B", "C", 1000.0))
    got = sorted(r["hop_out"] for r in network.chains(book_of(spark, rows), min_amount=100).collect())
    assert got == ["T00001", "T00003", "T00005", "T00009"]


def test_funnels(skewed, rows):
    got = {r["receiver_account"]: r for r in network.funnel_accounts(skewed).collect()}
    assert set(got) == {r["receiver_account"] for r in rows}
    for account, g in got.items():
        inbound = [r for r in rows if r["receiver_account"] == account]
        near = [r for r in inbound if in_band(r)]
        assert g["inbound_payments"] == len(inbound)
        assert g["distinct_senders"] == len({r["sender_account"] for r in inbound})
        assert g["near_threshold_senders"] == len({r["sender_account"] for r in near})
        assert g["is_funnel"] == (g["near_threshold_senders"] >= 3)


def test_slower_burst(skewed, rows, plan):
    targets = skewed.withColumn(whatif.STRUCTURING_TARGET, F.col("amount").between(7000, 9999.99))
    got = {r["transaction_id"]: r["us"] for r in whatif.slower_burst(targets, plan).collect()}
    for account in {r["receiver_account"] for r in rows}:
        mine = sorted(
            (r["us"], r["transaction_id"])
            for r in rows
            if r["receiver_account"] == account and in_band(r)
        )
        for position, (_, key) in enumerate(mine):
            assert got[key] == mine[0][0] + 10 * position * DAY
    for r in rows:
        if not in_band(r):
            assert got[r["transaction_id"]] == r["us"]


def test_salted_lookup_keeps_every_row(spark, skewed, hot):
    accounts = [f"A{i}" for i in range(10)] + ["HOT"]
    dim = spark.createDataFrame([(a, f"home of {a}") for a in accounts], "k string, home string")
    plain = HotKeys().lookup(skewed, "sender_account", dim, "k")
    salted = hot.lookup(skewed, "sender_account", dim, "k")
    pick = ["transaction_id", "home"]
    assert sorted(map(tuple, salted.select(*pick).collect()), key=str) == sorted(
        map(tuple, plain.select(*pick).collect()), key=str
    )


def test_partitions_do_not_matter(spark, skewed, hot):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(
                (
                    ids(rules.structuring(skewed, hot=hot)),
                    ids(rules.rapid_movement(skewed, hot=hot)),
                )
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_fixture_is_skewed():
    rows = skewed_rows()
    legs = [r[2] for r in rows] + [r[3] for r in rows]
    assert legs.count("HOT") / len(legs) > 0.3


def test_account_age(spark, skewed, rows, plan):
    import datetime as dt

    from tallyguard.sources import schemas

    first = dt.date(2024, 1, 1)
    people = [(a, "X", first + dt.timedelta(days=i)) for i, a in enumerate(["HOT", "A1", "A2", "A3"])]
    people.append(("HOT", "X", first + dt.timedelta(days=50)))  # a repeated line: the earliest counts
    known = {a: d for a, _, d in reversed(people)}
    ages = {
        r["transaction_id"]: (r["timestamp"].date() - known[r["sender_account"]]).days
        for r in rows
        if r["sender_account"] in known
    }
    ordered = sorted(ages.values())
    middle = len(ordered) // 2
    median = ordered[middle] if len(ordered) % 2 else (ordered[middle - 1] + ordered[middle]) / 2
    got = features.with_tenure(skewed, spark.createDataFrame(people, schemas.CUSTOMERS), plan)
    for r in got.collect():
        assert r["sender_account_age_days"] == ages.get(r["transaction_id"], median)


def test_split_path_reads_its_input_once(skewed, hot):
    """The timeline is staged: the plan of a running total reads no table but that one."""
    legs = skewed.selectExpr("sender_account AS account", "us", "transaction_id", "1L AS one")
    read = running(legs, ["account"], ["us", "transaction_id"], {"n": ("sum", "one")}, hot)
    files = {f.split("/")[-2] for f in read.inputFiles()}
    assert len(files) == 1 and files.pop().startswith("timeline-")
