"""Every query of the subpackage with SQL gives the rows DuckDB gives; the others run."""

from __future__ import annotations

import pytest

from edgewright.llm.queries import QUERIES, SQL
from tests.compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    cols, expected = sql_rows(SQL[name], small)
    assert sorted(df.columns) == cols
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
