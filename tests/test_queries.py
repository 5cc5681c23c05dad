"""Queries against their SQL."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, database

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in spark_entry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) == ""


def test_entry_has_both_modes(spark):
    rows = {r["mode"]: r for r in spark_entry.entry(spark).collect()}
    assert set(rows) == {"clean", "corrupt"}
    for r in rows.values():
        assert r["recall_at_1"] <= r["recall_at_5"] <= r["recall_at_10"]
        assert r["mrr"] >= r["recall_at_1"]


def test_every_sql_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
