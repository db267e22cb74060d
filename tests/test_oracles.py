"""Every registered query against its SQL text in DuckDB."""

import os

import __spark_entry__ as entry
import compare
import pytest
from bolide.plans import catalog

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.queries()) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    assert compare.difference(df, duck, SQL[name]) is None
