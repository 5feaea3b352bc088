"""Multisets of rows of a Spark query and of its SQL in DuckDB, compared after rounding."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    try:
        return f"{float(v):.5f}" if float(v) == int(v) else str(v)
    except (TypeError, ValueError):
        return str(v)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def assert_same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(rel.columns), rel.fetchall())
