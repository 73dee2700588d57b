"""Run a registered query and its DuckDB SQL on the same files and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
TYPE_NAMES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(df, connection, sql: str) -> list[str]:
    """Empty when names, types and rows are the same."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    kinds = {column[0]: str(column[1]) for column in cursor.description}
    expected_names, expected = _rows(names, cursor.fetchall())
    found_names, found = _rows(df.columns, [tuple(row) for row in df.collect()])
    problems = []
    if found_names != expected_names:
        return [f"columns: {found_names} != {expected_names}"]
    for name, kind in df.dtypes:
        if TYPE_NAMES.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} != {kinds[name]}")
    if len(found) != len(expected):
        problems.append(f"rows: {len(found)} != {len(expected)}")
    different = [(a, b) for a, b in zip(found, expected) if a != b]
    if different:
        problems.append(f"{len(different)} of {len(found)} rows differ, first: {different[0]}")
    if not found:
        problems.append("no rows")
    return problems
