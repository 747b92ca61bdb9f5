"""Every registered query against its SQL in DuckDB, over whole tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle import compare, connect

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL.get(name), sf)
    assert ok, note


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
