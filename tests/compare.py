"""Compare a Spark result with a DuckDB result, value by value."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return f"f{value!r}"
    if isinstance(value, decimal.Decimal):
        return f"decimal{value}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(frame, connection, sql: str) -> tuple[int, str | None]:
    """Row count and the first difference, or None."""
    theirs = connection.execute(sql)
    names = [d[0] for d in theirs.description]
    expected = rows_of(names, theirs.fetchall())
    found = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return len(found), f"columns {sorted(frame.columns)} instead of {sorted(names)}"
    if len(found) != len(expected):
        return len(found), f"{len(found)} rows instead of {len(expected)}: {found[:2]} / {expected[:2]}"
    for a, b in zip(found, expected):
        if a != b:
            wrong = sum(x != y for x, y in zip(found, expected))
            return len(found), f"{wrong} rows differ, first {a} instead of {b}"
    return len(found), None
