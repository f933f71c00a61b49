"""Every registered query beside its SQL counterpart, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
# Queries without SQL. Those of the training-data subpackage have tests of their own.
ROWS_ONLY = {name for name in entry.queries() if name not in entry.oracle_sql()}


@pytest.fixture(scope="module")
def db():
    return check_oracle.database(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    state, note = check_oracle.compare(spark, db, name, SF)
    assert state == ("rows-only" if name in ROWS_ONLY else "ok"), note


def test_the_check_sees_differences(spark, db, monkeypatch):
    changed = {**entry.oracle_sql(), "popular_examples": entry.oracle_sql()["popular_examples"].replace("LIMIT 20", "LIMIT 19")}
    monkeypatch.setattr(entry, "oracle_sql", lambda: changed)
    assert check_oracle.compare(spark, db, "popular_examples", SF)[0] == "DIFF"


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "score" in frame.columns
