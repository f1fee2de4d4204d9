"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, connection, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    left_columns, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    right_columns, right = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if left == right:
        return None
    only_left, only_right = left - right, right - left
    return (
        f"{sum(left.values())} vs {sum(right.values())} rows; "
        f"{sum(only_left.values())} only in Spark, e.g. {str(next(iter(only_left), None))[:600]}; "
        f"{sum(only_right.values())} only in SQL, e.g. {str(next(iter(only_right), None))[:600]}"
    )
