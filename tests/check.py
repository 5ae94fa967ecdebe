"""Compares a query with its SQL check on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == int(value) else float(value)
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(frame):
    return _rows(frame.columns, [tuple(r) for r in frame.collect()])


def sql_rows(connection, sql):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return _rows(columns, result.fetchall())


def differences(frame, connection, sql) -> str | None:
    """What differs, or none."""
    columns, got = spark_rows(frame)
    sql_columns, want = sql_rows(connection, sql)
    if columns != sql_columns:
        return f"columns {columns} but SQL has {sql_columns}"
    if got == want:
        return None
    extra = sorted(set(got) - set(want), key=repr)[:3]
    lacking = sorted(set(want) - set(got), key=repr)[:3]
    return f"{len(got)} rows, SQL {len(want)}; only Spark {extra}; only SQL {lacking}"
