"""Comparison of a Spark result with DuckDB's, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in Path(folder).iterdir():
        name = table.name.split(".")[0]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{table}{'/*.parquet' if table.is_dir() else ''}'")
    return con


def _plain(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    other = con.sql(sql)
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    ours = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in other.fetchall())
    assert ours == theirs
