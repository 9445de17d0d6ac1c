"""Boundary cases of the rules on hand-made books."""

import pytest
from conftest import book_of, ids, payment

from tallyguard.operators import rules

DAY = 24


def burst_at(spark, days, **options):
    rows = [payment(i, d * DAY, amount=9500.0, sender=f"S{i}") for i, d in enumerate(days)]
    return [int(i[1:]) for i in ids(rules.structuring(book_of(spark, rows), **options))]


@pytest.mark.parametrize(
    "days, flagged",
    [
        ([0, 2, 4], [0, 1, 2]),
        ([0, 20, 40], []),
        ([0, 1, 2, 60], [0, 1, 2]),
        ([0, 3.5, 7], [0, 1, 2]),
        ([0, 3.5, 7.001], []),
        ([0, 0, 0], [0, 1, 2]),
        ([0, 5, 7, 12], [0, 1, 2, 3]),
    ],
)
def test_burst_windows(spark, days, flagged):
    assert burst_at(spark, days) == flagged


def test_window_ends_are_inclusive(spark):
    assert burst_at(spark, [0, 7], min_count=2) == [0, 1]
    assert burst_at(spark, [0, 7.001], min_count=2) == []


def test_band_is_half_open(spark):
    amounts = [7000.0, 9999.99, 8000.0, 10000.0, 6999.99]
    rows = [payment(i, i, amount=a) for i, a in enumerate(amounts)]
    assert ids(rules.structuring(book_of(spark, rows))) == ["T00000", "T00001", "T00002"]


def test_sender_side_alone(spark):
    rows = [payment(i, i, receiver=f"R{i}", amount=9000.5) for i in range(3)]
    assert len(ids(rules.structuring(book_of(spark, rows)))) == 3


def test_unrelated_pairs_are_no_burst(spark):
    rows = [payment(i, i, sender=f"S{i}", receiver=f"R{i}", amount=9000.5) for i in range(3)]
    assert ids(rules.structuring(book_of(spark, rows))) == []


def test_sides_of_one_account_do_not_mix(spark):
    # X receives two and sends two in-band payments within a week: no side has three
    rows = [
        payment(0, 0, "A", "X", 9000.5),
        payment(1, 10, "X", "B", 9000.5),
        payment(2, 20, "C", "X", 9000.5),
        payment(3, 30, "X", "D", 9000.5),
    ]
    assert ids(rules.structuring(book_of(spark, rows))) == []


def rapid(spark, *rows, **options):
    return [int(i[1:]) for i in ids(rules.rapid_movement(book_of(spark, list(rows)), **options))]


def credit(hours=0.0, amount=20_000.0, i=0):
    return payment(i, hours, "SRC", "MULE", amount)


def debit(i, hours, amount):
    return payment(i, hours, "MULE", f"D{i}", amount)


@pytest.mark.parametrize(
    "hours, flagged", [(6, [0, 1]), (24, [0, 1]), (24.001, []), (25, []), (0, []), (-1, [])]
)
def test_debit_time(spark, hours, flagged):
    assert rapid(spark, credit(), debit(1, hours, 19_000.0)) == flagged


def test_share_passed_on(spark):
    assert rapid(spark, credit(), debit(1, 5, 10_000.0)) == []
    assert rapid(spark, credit(), debit(1, 5, 16_000.0)) == [0, 1]
    assert rapid(spark, credit(), debit(1, 5, 15_999.99)) == []


def test_split_outflow_flags_every_leg(spark):
    legs = [debit(i, i, 5_500.0) for i in (1, 2, 3)]
    assert rapid(spark, credit(), *legs) == [0, 1, 2, 3]


def test_small_credit(spark):
    assert rapid(spark, credit(amount=500.0), debit(1, 5, 490.0)) == []
    assert rapid(spark, credit(amount=500.0), debit(1, 5, 490.0), min_amount=100) == [0, 1]


def test_payment_to_self(spark):
    rows = [payment(0, 0, "X", "X", 5000.0), payment(1, 3, "X", "X", 5000.0)]
    assert rapid(spark, *rows) == [0, 1]


@pytest.mark.parametrize(
    "legs, hit, exposure",
    [
        (("Panama", "United Kingdom"), True, "sender"),
        (("United Kingdom", "Malta"), True, "receiver"),
        (("Cyprus", "Seychelles"), True, "both legs"),
        (("United Kingdom", "France"), False, None),
        ((None, "Malta"), True, "receiver"),
        ((None, None), False, None),
    ],
)
def test_high_risk_country(spark, legs, hit, exposure):
    book = book_of(spark, [payment(0, countries=legs)])
    found = book.filter(rules.is_high_risk()).select(rules.exposure().alias("e")).collect()
    assert bool(found) == hit
    if hit:
        assert found[0]["e"] == exposure


@pytest.mark.parametrize(
    "amount, hit", [(5000.0, True), (5000.37, False), (500.0, False), (1000.0, True)]
)
def test_round_amount(spark, amount, hit):
    assert bool(book_of(spark, [payment(0, amount=amount)]).filter(rules.is_round()).count()) == hit


def test_two_rules_on_one_payment(spark):
    book = book_of(spark, [payment(0, amount=9000.0, countries=("Panama", "France")), payment(1)])
    rows = {r["transaction_id"]: r for r in rules.apply_all(book).collect()}
    assert rows["T00000"]["rules_fired"] == 2
    assert rows["T00000"]["rule_reasons"] == "high_risk_country, round_amount"
    assert rows["T00001"]["rules_fired"] == 0 and rows["T00001"]["rule_reasons"] == ""
    assert not rows["T00001"]["rule_alert"]
