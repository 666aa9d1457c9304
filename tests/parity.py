"""Compares a Spark result with what DuckDB makes of the same Parquet files."""

from __future__ import annotations

import decimal

import duckdb

from recordspine.plans.views import BASE


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def assert_same(df, sql: str, sf_dir: str) -> int:
    c = connect(sf_dir)
    c.execute(sql)
    columns = [d[0] for d in c.description]
    want = rows(columns, c.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
