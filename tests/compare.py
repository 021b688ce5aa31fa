"""Rows of a Spark query and of its DuckDB SQL as multisets."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def spark_rows(df) -> Counter:  # noqa: ANN001
    cols = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(sql: str, folder: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    out = con.sql(sql)
    cols, at = sorted(out.columns), {c: i for i, c in enumerate(out.columns)}
    return cols, Counter(tuple(plain(r[at[c]]) for c in cols) for r in out.fetchall())
