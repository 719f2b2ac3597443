"""Every registered query against its SQL, or against row counts where it has none."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, connection, name):
    _, difference = compare(QUERIES[name](spark, sf), connection, SQL[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
