"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares rows whatever their order."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb

FOLDER = os.environ.get("HALYARD_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.8g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connect():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def check(spark, con, query, sql):
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(plain(tuple(r[c] for c in columns)) for r in df.collect())
    if sql is None:
        assert columns
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(plain(tuple(r[i] for i in at)) for r in found.fetchall())
