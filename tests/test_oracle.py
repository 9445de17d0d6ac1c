"""Every registered query with checking SQL, on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from tallyguard.catalog import inputs

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not found")


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    verdict, _ = check.compare(spark, db, FOLDER, name)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0


SPLIT = (
    "structuring_flags",
    "rapid_movement_flags_default_floor",
    "rules_applied",
    "clean_book",
    "feature_matrix",
    "structuring_evidence",
    "rapid_evidence",
    "whatif_all",
    "case_list",
    "alert_payload",
    "velocity_features",
)


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_every_account_split(spark, db, name, monkeypatch):
    from tallyguard.plans import skew

    monkeypatch.setattr(skew.find_hot, "__defaults__", (*skew.find_hot.__defaults__[:2], 20, 8))
    assert skew.find_hot(inputs.book(spark, FOLDER)).keys.count() > 10
    verdict, _ = check.compare(spark, db, FOLDER, name)
    assert verdict.startswith("ok"), verdict
