"""Comparison of a query with its DuckDB form on one of the driver's table sizes."""

from __future__ import annotations

import decimal
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def available() -> bool:
    return os.path.isdir(SF)


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def compare(spark, query, sql: str) -> None:
    got = query(spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = [tuple(plain(r[c]) for c in order) for r in got.collect()]
    b = [tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()]
    assert sorted(a, key=repr) == sorted(b, key=repr)
