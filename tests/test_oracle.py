"""Every registered query with SQL gives the same rows on DuckDB."""

import sys

import pytest
from compare import database, differences
from conftest import ROOT, SMALL

sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(entry.queries())
