"""Every registered query against its SQL twin, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["index", "rank", "chunk_index", "score", "text"]
    assert df.count() == 200


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
