"""Comparing a query with its SQL in DuckDB."""

import math
import os

import duckdb


def connected(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in os.listdir(folder):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return connection


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def assert_equal(frame, connection, sql: str) -> None:
    columns = sorted(frame.columns)
    got = _sorted([tuple(_plain(row[c]) for c in columns) for row in frame.collect()])
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = _sorted([tuple(_plain(row[i]) for i in places) for row in found.fetchall()])
    assert got == want
