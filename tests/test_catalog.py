"""Every registered query runs and agrees with its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, sql, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    if name in entry.oracle_sql():
        assert difference(ours, sql.execute(entry.oracle_sql()[name]).df()) is None
    else:
        assert len(ours)


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
