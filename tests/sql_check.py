"""Compare a query's rows with the rows of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value) if isinstance(value, str) else repr(float(value))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(record[i]) for i in order) for record in records)


def differences(df, connection, sql) -> list[str]:
    """What differs; empty when names, row counts and values agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    wanted = rows_of(names, result.fetchall())
    found = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if len(found) != len(wanted):
        return [f"{len(found)} rows against {len(wanted)}"]
    return [f"{a} against {b}" for a, b in zip(found, wanted) if a != b]
