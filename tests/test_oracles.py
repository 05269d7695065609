"""Every catalogue query with SQL gives the same rows in both engines."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from rankloom.catalog import ORACLES, QUERIES
from tests.compare import connect, run

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = run(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert problem is None
    assert rows > 0 or name == "quality_duplicates"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"user_idx", "item_idx", "split", "rating_deviation"} <= set(df.columns)
