"""Requests: golden numbers, null rules, time frames, paging, security."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from halyard.plans.model import Attribute, EntityModel, ModelError, Registry
from halyard.plans.planner import Engine
from halyard.plans.predicates import FilterError, compile_filter
from halyard.plans.request import RequestError, Security, cursor_of, parse_batch, parse_request
from halyard.plans.timeframe import TimeFrame, compare_range, shift, truncate

NOW = dt.datetime(2025, 10, 9, 8, 53, 20)
MODEL = EntityModel("log", tuple(Attribute(n, t) for n, t in (("id", "long"), ("category", "string"), ("priority", "integer"), ("cost", "double"), ("hours", "double"), ("created_at", "epoch"), ("active", "boolean"))), "id", time="created_at")


def engine(spark, rows) -> Engine:
    df = spark.createDataFrame(rows, "id long, category string, priority int, cost double, hours double, created_at timestamp_ntz, active boolean")
    return Engine(spark, Registry([MODEL]), lambda _: df, NOW)


@pytest.fixture(scope="module")
def costs(spark):
    return engine(spark, [(i, "HVAC" if i < 3 else None, i, 10.0 * i, 2.0 * i, NOW - dt.timedelta(days=i), i % 2 == 0) for i in range(1, 5)])


def one(e, **body):
    return e.run({"entity": "log", **body}).whole.first().asDict()


def metric(fn, attribute="cost", **more):
    return {"aggregation": fn, "attribute": attribute, "name": "x", **more}


@pytest.mark.parametrize("fn,want", [("COUNT", 4), ("SUM", 100), ("AVG", 25), ("MIN", 10), ("MAX", 40), ("MEDIAN", 30), ("P90", 40), ("P95", 40), ("P99", 40)])
def test_aggregates(costs, fn, want):
    assert one(costs, metrics=[metric(fn)])["x"] == want


def test_bivariate(costs, spark):
    assert one(costs, metrics=[metric("CORRELATION", secondary="hours")])["x"] == pytest.approx(1)
    assert one(costs, metrics=[metric("LINEAR_REGRESSION", secondary="hours")])["x"] == pytest.approx(5)
    flat = engine(spark, [(i, "a", 1, 5.0, 5.0, NOW, True) for i in range(2)])
    assert one(flat, metrics=[metric("CORRELATION", secondary="hours")])["x"] == 0
    assert one(flat, metrics=[metric("LINEAR_REGRESSION", secondary="hours")])["x"] == 0
    assert one(flat, metrics=[metric("STD_DEV")])["x"] == 0


def test_logistic_metric(spark):
    from halyard.functions.stats import logistic

    e = engine(spark, [(i, "a" if i < 11 else "b", int(i > 5 and i < 11), float(i % 11), 1.0, NOW, True) for i in range(1, 15)])
    got = {r.category: r.x for r in e.run({"entity": "log", "dimensions": ["category"], "metrics": [metric("LOGISTIC_REGRESSION", "priority", secondary="cost")]}).whole.collect()}
    assert got["b"] is None and got["a"] == pytest.approx(logistic(e.table("log").where("category = 'a'"), "cost", "priority")[1], rel=1e-6)


def test_cache(costs):
    body = {"entity": "log", "metrics": [metric("SUM")]}
    assert costs.cached(body) is costs.cached(dict(body)) and costs.cached(body) is not costs.cached(body, Security(user=1))
    costs.forget()


def test_count_of_text_counts_rows(costs):
    assert one(costs, metrics=[metric("COUNT", "category")])["x"] == 4


def test_empty_input_is_zero(costs):
    assert set(one(costs, filters=[["=", "category", "none"]], metrics=[metric("SUM"), {**metric("AVG"), "name": "y"}, {**metric("P90"), "name": "z"}]).values()) == {0.0}


def test_kpi_of_a_measure_with_a_shift(spark):
    e = engine(spark, [(1, "a", 1, 100.0, 4.0, NOW - dt.timedelta(days=1), True), (2, "a", 1, 300.0, 6.0, NOW - dt.timedelta(days=2), True), (3, "a", 1, 200.0, 5.0, NOW - dt.timedelta(days=10), True)])
    row = one(e, measures=[{"name": "double_hours", "formula": "hours * 2"}], metrics=[metric("SUM", "double_hours")], time_frame={"type": "LAST_N_DAYS", "n": 7})
    assert row["x"] == 20
    row = one(e, metrics=[metric("SUM")], time_frame={"type": "LAST_N_DAYS", "n": 7}, comparisons=[{"type": "TIME_SHIFT_RELATIVE", "granularity": "day", "amount": 7}])
    assert (row["x"], row["previous_value"]) == (400, 200)
    assert one(e, metrics=[metric("SUM")], comparisons=[{"type": "BENCHMARK", "value": 250}])["previous_value"] == 250


def test_casts(spark):
    e = engine(spark, [(1, "HVAC", 1, 500.0, 2.5, NOW, True), (2, "HVAC", 1, 300.0, 2.5, NOW, True), (3, "ELEC", 2, 900.0, 1.5, NOW, True), (4, "", None, 100.0, None, NOW, None)])
    pie = [(r.category, r.x) for r in e.run({"entity": "log", "cast": "PIE", "dimensions": ["category"], "metrics": [metric("SUM")]}).whole.collect()]
    assert pie == [("ELEC", 900), ("HVAC", 800)]
    assert e.run({"entity": "log", "dimensions": ["category"], "metrics": [metric("SUM")]}).whole.count() == 3
    assert one(e, cast="TABLE", metrics=[metric("SUM")])["x"] == 1800


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", 1.0), (3, "Técnico", 2.0)], "id int, s string, n double")
    ids = lambda f: sorted(r.id for r in df.where(compile_filter(df, f)).collect())
    assert ids(["=", "s", "x"]) == [2]
    assert ids(["!=", "s", "x"]) == [1, 3]
    assert ids([">", "n", 1]) == [3] and ids(["<=", "n", 1]) == [2]
    assert ids(["in", "s", ["x", "y"]]) == [2] and ids(["not-in", "s", ["x"]]) == [1, 3]
    assert ids(["not-in", "s", ["x", ""]]) == [3] and ids(["not-in", "s", []]) == [1, 2, 3]
    assert ids(["contains", "s", "TECNICO"]) == [3] and ids(["contains", "s", ""]) == []
    assert ids(["like", "s", "t%o"]) == [3]
    assert ids(["is-null", "s"]) == [1] and ids(["not", ["is-null", "s"], ["=", "n", 1]]) == [1, 2, 3] and ids(["not", ["=", "n", 1]]) == [1, 3]
    assert ids(["=", "s", 5]) == [] and ids(["!=", "s", 5]) == [1, 2, 3]
    assert ids(["between", "s", "a", "y"]) == [2] and ids(["or"]) == [1, 2, 3]
    with pytest.raises(FilterError):
        ids({"field": "s", "op": "SOUNDS", "value": 1})
    with pytest.raises(ModelError):
        ids(["=", "nothing", 1])


def test_contains_in_arrays(spark):
    df = spark.createDataFrame([(1, ["Rol de Administrador"]), (2, []), (3, None)], "id int, roles array<string>")
    assert [r.id for r in df.where(compile_filter(df, ["contains", "roles", "administrador"])).collect()] == [1]


@pytest.mark.parametrize("kind,n,lo,hi", [
    ("TODAY", 1, "2025-10-09", "2025-10-10"), ("YESTERDAY", 1, "2025-10-08", "2025-10-09"), ("TOMORROW", 1, "2025-10-10", "2025-10-11"), ("LAST_WEEK", 1, "2025-09-29", "2025-10-06"), ("NEXT_MONTH", 1, "2025-11-01", "2025-12-01"),
    ("LAST_QUARTER", 1, "2025-07-01", "2025-10-01"), ("LAST_YEAR", 1, "2024-01-01", "2025-01-01"), ("THIS_QUARTER", 1, "2025-10-01", "2025-10-09T08:53:20"), ("YEAR_TO_DATE", 1, "2025-01-01", "2025-10-09T08:53:20"), ("LAST_N_MONTHS", 2, "2025-08-01", "2025-10-09T08:53:20"), ("NEXT_N_WEEKS", 1, "2025-10-09T08:53:20", "2025-10-16T08:53:20"),
])
def test_time_frames(kind, n, lo, hi):
    assert TimeFrame(kind, n).resolve(NOW) == (dt.datetime.fromisoformat(lo), dt.datetime.fromisoformat(hi))


def test_calendar():
    assert shift(dt.datetime(2025, 1, 31), 1, "month") == dt.datetime(2025, 2, 28)
    assert truncate(dt.datetime(2025, 5, 31, 5), "quarter") == dt.datetime(2025, 4, 1)
    assert truncate(dt.datetime(2025, 3, 9, 12), "day", "America/New_York") == dt.datetime(2025, 3, 9, 5)
    assert truncate(dt.datetime(2025, 3, 10, 12), "day", "America/New_York") == dt.datetime(2025, 3, 10, 4)
    assert TimeFrame("ALL_TIME").resolve(NOW) is None
    cur = (dt.datetime(2025, 3, 1), dt.datetime(2025, 3, 8))
    assert compare_range("TIME_SHIFT_SHORTCUT", cur, shortcut="PREVIOUS_PERIOD") == (dt.datetime(2025, 2, 22), dt.datetime(2025, 3, 1))
    assert compare_range("TIME_SHIFT_SHORTCUT", cur, shortcut="YESTERDAY_LAST_MONTH") == (dt.datetime(2025, 1, 28), dt.datetime(2025, 2, 1))


def test_time_frames_take_both_ends(spark):
    e = engine(spark, [(i, "a", 1, 1.0, 1.0, t, True) for i, t in enumerate([dt.datetime(2025, 10, 8), dt.datetime(2025, 10, 9), dt.datetime(2025, 10, 9, 0, 0, 1)])] + [(9, "a", 1, 1.0, 1.0, None, True)])
    assert one(e, metrics=[metric("COUNT")], time_frame={"type": "YESTERDAY"})["x"] == 2


def test_paging(costs):
    r = costs.run({"entity": "log", "sort": [{"field": "cost", "descending": True}], "limit": 3})
    assert [x.id for x in r.rows.collect()] == [4, 3, 2]
    page = r.page()
    assert page.has_next and page.next == cursor_of(3, 3) and page.previous is None
    rest = costs.run({"entity": "log", "sort": [{"field": "cost", "descending": True}], "cursor": page.next})
    assert [x.id for x in rest.rows.collect()] == [1] and rest.page().previous == cursor_of(0, 3)
    assert [x.id for x in costs.run({"entity": "log", "cursor": "nonsense!", "limit": 2}).rows.collect()] == [1, 2]


def test_checks():
    for bad in ({}, {"entity": "log", "cast": "KPI"}, {"entity": "log", "metrics": [{"aggregation": "SUM"}]}, {"entity": "log", "dimensions": [{"attribute": "a", "interval": "fortnight"}]}, {"entity": "log", "cast": "MAP"}, {"entity": "log", "limit": -1}):
        with pytest.raises(RequestError):
            parse_request(bad)
    with pytest.raises(RequestError):
        parse_batch({str(i): {"entity": "log"} for i in range(26)})
    got = parse_batch({"a": {"filters": [["=", "x", 1]]}}, common_filters=[["=", "y", 2]], entity="log")
    assert got["a"].entity == "log" and [f[1] for f in got["a"].filters] == ["y", "x"]


def test_batch_runs(costs):
    got = costs.run_batch({"n": {"entity": "log", "metrics": [metric("COUNT")]}, "rows": {"entity": "log", "limit": 2}})
    assert got["n"][0].x == 4 and len(got["rows"]) == 2


def test_security(spark):
    model = EntityModel("log", MODEL.attributes + (Attribute("secret", "string", sensitive=True), Attribute("t", "string"), Attribute("who", "array")), "id", tenant="t", owner="category", assignees="who")
    df = spark.createDataFrame([(1, "me", "s", "a", []), (2, "you", "s", "a", ["me"]), (3, "you", "s", "a", ["you"]), (4, "me", "s", "b", [])], "id long, category string, secret string, t string, who array<string>")
    e = Engine(spark, Registry([model]), lambda _: df, NOW)
    ids = lambda **s: sorted(r.id for r in e.run({"entity": "log"}, Security(tenant="a", user="me", **s)).whole.collect())
    assert ids() == [1, 2, 3] and ids(scopes=("OWN",)) == [1] and ids(scopes=("ASSIGNED",)) == [2] and ids(scopes=("OWN", "ASSIGNED")) == [1, 2] and ids(scopes=("NONE",)) == []
    assert "secret" not in e.run({"entity": "log"}, Security(tenant="a")).whole.columns
    with pytest.raises(PermissionError):
        e.run({"entity": "log"})


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(i, f"c{i}", i, float(i), 1.0, NOW, True) for i in range(10)], "id long, category string, priority int, cost double, hours double, created_at timestamp_ntz, active boolean").write.parquet(path)
    e = Engine(spark, Registry([MODEL]), lambda _: spark.read.parquet(path), NOW)
    plan = e.explain({"entity": "log", "filters": [[">", "cost", 3], ["=", "category", "c5"]], "metrics": [metric("SUM", "hours")]})
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "GreaterThan(cost,3" in scan and "EqualTo(category,c5)" in scan and "priority" not in scan.split("ReadSchema")[1]


def test_random_requests_against_sql(spark):
    rng = random.Random(42)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, None]), rng.choice([None, *map(float, range(20))]), float(rng.randrange(9)), NOW - dt.timedelta(hours=rng.randrange(500)), rng.choice([True, False, None])) for i in range(300)]
    e = engine(spark, rows)
    con = duckdb.connect()
    con.execute("create table log (id bigint, category varchar, priority int, cost double, hours double, created_at timestamp, active boolean)")
    con.executemany("insert into log values (?, ?, ?, ?, ?, ?, ?)", rows)

    def leaf():
        c = rng.choice(["category", "priority", "cost"])
        if c == "category":
            v = rng.choice("abc")
            return rng.choice([(["=", c, v], f"coalesce(category = '{v}', false)"), (["!=", c, v], f"coalesce(category <> '{v}', true)"), (["in", c, ["a", v]], f"coalesce(category in ('a', '{v}'), false)")])
        v, (op, sql) = rng.randrange(12), rng.choice([(">", ">"), (">=", ">="), ("<", "<"), ("<=", "<="), ("=", "=")])
        return [op, c, v], f"coalesce({c} {sql} {v}, false)"

    def tree(depth):
        if not depth or rng.random() < 0.4:
            return leaf()
        kind = rng.choice(["and", "or", "not"])
        parts = [tree(depth - 1) for _ in range(rng.randint(1, 3))]
        sql = f"({' OR ' if kind == 'or' else ' AND '})".strip("()").join(p[1] for p in parts)
        return [kind, *(p[0] for p in parts)], f"NOT ({sql})" if kind == "not" else f"({sql})"

    for _ in range(12):
        node, sql = tree(3)
        want = con.execute(f"select count(*), coalesce(sum(hours), 0) from log where {sql}").fetchone()
        got = one(e, filters=[node], metrics=[{"aggregation": "COUNT", "name": "n"}, metric("SUM", "hours")])
        assert (got["n"], got["x"]) == want, node


def test_discovery_and_models(spark):
    r = Registry([EntityModel.from_json('{"name": "a", "attributes": [{"name": "cost_total", "type": "decimal"}, {"name": "state", "type": "enum", "options": ["on_call"]}]}')])
    rows = {x.attribute: x for x in r.discovery(spark).collect()}
    assert rows["cost_total"].label == "Cost Total" and rows["cost_total"].aggregatable and rows["state"].options == ["on_call=On Call"]
    with pytest.raises(ModelError):
        Attribute("x", "colour")
    assert F.lit(1) is not None
