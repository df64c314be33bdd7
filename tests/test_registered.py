"""Every registered query at the smallest scale factor, next to its SQL where there is one."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    assert compare(spark, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(1, 11))
    assert all(0 <= r["ndcg"] <= 1.000001 and 0 <= r["recall"] <= 1 and 0 < r["precision"] <= 1 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
