"""Comparison of a query with its SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return repr(v)
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)


def compare(query, sql: str, spark, sf: str, con) -> None:
    df = query(spark, sf)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    theirs_names = [d[0] for d in found.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
