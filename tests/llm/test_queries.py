"""Queries with SQL give the same rows in DuckDB."""

import pytest
from compare import connect, differences

from fieldloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert differences(queries.QUERIES[name](spark, DIR), connect(DIR), queries.ORACLES[name]) == []
