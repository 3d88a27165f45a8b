"""Compares a query with its SQL in DuckDB as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", round(value, 6))
    return (type(value).__name__, value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con) -> tuple[int, str | None]:
    """(rows, difference or None)."""
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return sum(got.values()), f"columns {got_columns} <> {want_columns}"
    if got != want:
        return sum(got.values()), (
            f"rows {sum(got.values())} <> {sum(want.values())};"
            f" only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
        )
    return sum(got.values()), None
