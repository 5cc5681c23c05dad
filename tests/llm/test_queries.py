"""Every query with SQL against it, on a small scale; the others give rows."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, database

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in spark_entry.queries() if n.startswith("op") and n[2].isdigit())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert compare(spark, database(FOLDER), FOLDER, name) == ""


def test_all_operators():
    assert {int(n[2:].split("_")[0]) for n in NAMES} == set(range(1, 14))
    assert "pipeline" in spark_entry.queries()
