"""Every query with SQL gives the same rows in DuckDB; every other one runs."""

import pytest
from compare import connect, differences

from fieldloom import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    if name in catalog.ORACLES:
        assert differences(df, con, catalog.ORACLES[name]) == []
    else:
        assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
