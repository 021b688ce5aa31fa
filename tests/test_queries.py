"""Every core query with SQL gives the rows DuckDB gives; the others run."""

from __future__ import annotations

import pytest

import __spark_entry__
from edgewright import core_queries, graph_queries
from tests.compare import spark_rows, sql_rows

MODULES = (core_queries, graph_queries)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    cols, expected = sql_rows(SQL[name], small)
    assert sorted(df.columns) == cols
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
