"""Queries read whole tables, also where ids are above those of the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from halyard.queries import ORACLES, QUERIES
from tests import compare


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(7), []
    for item in (1, 200, 201, 5000):
        for k in range(9):
            q = float(rng.randint(1, 9))
            rows.append((item * 20 + k // 2, k % 2 + 1, item, item, q, q * (k + 1.25), dt.datetime(2024, 1, 1 + k)))
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path, rows


def test_issue_without_stock_left(spark, tmp_path):
    import duckdb

    quantities = [1.0, 1.0, 2.0, 1.0, 1.0, 9.0, 1.0, 1.0, 3.0]  # 6 received, 14 issued
    rows = [(k, 1, 77, 1, q, 2 * q, dt.datetime(2024, 1, 1 + k)) for k, q in enumerate(quantities)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")
    got = sorted((r.issue_id, r.filled, r.cogs) for r in QUERIES["fifo_cogs"](spark, path).collect())
    assert got == [(3, 2.0, 4.0), (6, 4.0, 8.0), (9, 0.0, 0.0)]
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}/lineitem.parquet/*.parquet'")
    assert sorted(con.execute(f"select issue_id, filled, cogs from ({ORACLES['fifo_cogs']})").fetchall()) == got


def brute_issues(rows, method):
    """(item, issue_id, filled, cogs): two of three rows are received, the third is issued."""
    out = []
    for item in sorted({r[2] for r in rows}):
        stock = []
        for k, r in enumerate(sorted((r for r in rows if r[2] == item), key=lambda r: r[6]), 1):
            if k % 3:
                stock.append([r[4], math.floor(r[5] / r[4] * 100) / 100])
                continue
            left, cost = r[4], 0.0
            if method == "WAC":
                have = sum(q for q, _ in stock)
                mean = sum(q * c for q, c in stock) / have
                took = min(left, have)
                left, cost, stock = left - took, took * mean, [[have - took, mean]]
            while left > 0 and stock and method == "LIFO":
                took = min(left, stock[-1][0])
                left, cost = left - took, cost + took * stock[-1][1]
                stock[-1][0] -= took
                if not stock[-1][0]:
                    stock.pop()
            out.append((item, k, r[4] - left, cost))
    return out


@pytest.mark.parametrize("method", ["LIFO", "WAC"])
def test_issues_of_all_items(spark, folder, method):
    path, rows = folder
    got = sorted((r.item, int(r.issue_id), r.filled, r.cogs) for r in QUERIES[f"{method.lower()}_cogs"](spark, path).collect())
    want = brute_issues(rows, method)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-3)


@pytest.mark.parametrize("name", ["fifo_cogs", "running_wac", "hamilton_allocation"])
def test_all_ids(spark, folder, monkeypatch, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder[0]}/lineitem.parquet/*.parquet'")
    monkeypatch.setattr(compare, "FOLDER", folder[0])
    compare.check(spark, con, QUERIES[name], ORACLES[name])


def test_edit_distance_of_long_names(spark, tmp_path):
    spark.createDataFrame([(1, "small rnig"), (2, "small rnig and more")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.p_partkey: r.d for r in QUERIES["edit_distance"](spark, str(tmp_path)).collect()} == {1: 0, 2: 9}


def test_places_of_many_customers(spark, tmp_path):
    import duckdb

    keys = [None, 5, 5, 5, *(k + 10_000 * i for k in range(0, 9000, 90) for i in range(7))]  # seven customers a place; one row three times
    path = str(tmp_path)
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    df = QUERIES["geo_distance_join"](spark, path)
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{path}/customer.parquet/*.parquet'")
    got = sorted((r.a, r.b) for r in df.collect())
    assert got == sorted(con.execute(ORACLES["geo_distance_join"]).fetchall()) and got.count((5, 5)) == 9
    last = df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Aggregate" not in last and "Distinct" not in last  # the pairs are not shuffled
