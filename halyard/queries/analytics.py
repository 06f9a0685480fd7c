"""Requests: filters, aggregates, output shapes, time, comparisons, formulas, relations, security."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.catalog import bitmap_cardinality, explore, list_ids, overlay, row_bitmaps, same_rows
from halyard.operators.hierarchy import closure, euler, inherited, interval_join, roll_up, subtree
from halyard.operators.relations import references_to, route
from halyard.plans.model import Attribute, EntityModel, Registry
from halyard.plans.planner import Engine, intelligence, merge_series
from halyard.plans.request import Security
from halyard.queries.registry import NOW, engine, query, request
from halyard.sources.csv_sink import safe_cells
from halyard.sources.tables import REGISTRY, load_table, loader

# filters: missing values as the operators define them

_COUNT = [{"aggregation": "COUNT", "name": "n"}]
_N = "count(*)::DOUBLE AS n"


def _filter(name: str, entity: str, where: str, *filters) -> None:
    request(name, f"SELECT {_N} FROM {entity} WHERE {where}", entity=entity, filters=list(filters), metrics=_COUNT)


_filter("filter_eq", "orders", "o_orderstatus = 'O'", {"field": "orders/o_orderstatus", "op": "EQ", "value": "O"})
_filter("filter_eq_other_type", "orders", "false", {"field": "o_orderstatus", "op": "EQ", "value": 5})
_filter("filter_neq", "orders", "o_orderstatus <> 'O'", {"field": "o_orderstatus", "op": "NEQ", "value": "O"})
_filter("filter_gt_lte", "lineitem", "l_quantity > 10 AND l_quantity <= 30", {"field": "l_quantity", "op": "GT", "value": 10}, {"field": "l_quantity", "op": "LTE", "value": 30})
_filter("filter_gte_lt", "part", "p_size >= 10 AND p_size < 20", {"field": "p_size", "op": "GTE", "value": 10}, {"field": "p_size", "op": "LT", "value": 20})
_filter("filter_in", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH')", {"field": "o_orderpriority", "op": "IN", "value": "1-URGENT, 2-HIGH"})
_filter("filter_not_in", "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", {"field": "o_orderpriority", "op": "NOT_IN", "value": ["1-URGENT", "2-HIGH"]})
_filter("filter_between", "orders", "o_totalprice BETWEEN 1000 AND 90000", {"field": "o_totalprice", "op": "BETWEEN", "value": [1000, 90000]})
_filter("filter_between_text", "customer", "c_mktsegment BETWEEN 'B' AND 'F'", {"field": "c_mktsegment", "op": "BETWEEN", "value": ["B", "F"]})
_filter("filter_between_time", "orders", "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'", {"field": "o_orderdate", "op": "BETWEEN", "value": ["1996-01-01", "1996-12-31"]})
_filter("filter_like", "part", "lower(p_name) LIKE '%a_t%'", {"field": "p_name", "op": "LIKE", "value": "%A_T%"})
_filter("filter_contains", "documents", "contains(translate(lower(text), 'áéíóúüñ', 'aeiouun'), 'cion')", {"field": "text", "op": "CONTAINS", "value": "CIÓN"})
_filter("filter_null", "events", "value IS NOT NULL AND NOT props IS NULL", {"field": "value", "op": "IS_NOT_NULL"}, {"conjunction": "NOT", "nodes": [{"field": "props", "op": "IS_NULL"}]})
_filter("filter_or_tree", "orders", "(o_orderstatus = 'F' OR (o_totalprice > 200000 AND o_orderpriority = '5-LOW'))",
        {"conjunction": "OR", "nodes": [{"field": "o_orderstatus", "op": "EQ", "value": "F"}, {"conjunction": "AND", "nodes": [{"field": "o_totalprice", "op": "GT", "value": 200000}, {"field": "o_orderpriority", "op": "EQ", "value": "5-LOW"}]}]})
_filter("filter_not_group", "orders", "NOT (o_orderstatus = 'F' AND o_totalprice > 100000)", {"conjunction": "NOT", "nodes": [{"field": "o_orderstatus", "op": "EQ", "value": "F"}, {"field": "o_totalprice", "op": "GT", "value": 100000}]})
_filter("filter_list_form", "orders", "o_orderstatus = 'O' AND (o_totalprice >= 50000 OR o_orderpriority <> '5-LOW')", ["and", ["=", "o_orderstatus", "O"], ["or", [">=", "o_totalprice", 50000], ["!=", "o_orderpriority", "5-LOW"]]])
_filter("filter_empty_group", "orders", "true", {"conjunction": "AND", "nodes": []})


@query("SELECT doc_id FROM (SELECT NULL::VARCHAR AS v, 1::BIGINT AS doc_id UNION ALL SELECT 'x', 2 UNION ALL SELECT 'y', 3) WHERE v IS DISTINCT FROM 'x'")
def filter_neq_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.plans.predicates import compile_filter

    df = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "v string, doc_id long")
    return df.where(compile_filter(df, ["!=", "v", "x"])).select("doc_id")


# scans

request("scan_point", "SELECT * FROM orders WHERE o_orderkey = 7", entity="orders", entity_id=7)
request("scan_equality_intersect", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", entity="orders", filters=[["=", "o_orderstatus", "F"], ["=", "o_orderpriority", "1-URGENT"]], select=["o_orderkey", "o_custkey"])
request("scan_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 120000 AND o_orderstatus = 'O'", entity="orders", filters=[[">", "o_totalprice", 100000], ["<=", "o_totalprice", 120000], ["=", "o_orderstatus", "O"]], select=["o_orderkey", "o_totalprice"])
request("scan_full", "SELECT * FROM nation", entity="nation")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey = 17", doubles="l_quantity")
def scan_reverse_reference(spark, sf_dir):
    return references_to(load_table(spark, sf_dir, "lineitem"), "l_partkey", 17).select("l_orderkey", "l_linenumber", "l_quantity")


# aggregates and output shapes

_F = lambda *pairs: [{"aggregation": a, "attribute": x, **({"name": n} if n else {})} for a, x, n in pairs]
request("kpi_basic", "SELECT count(l_quantity)::DOUBLE AS count_l_quantity, sum(l_quantity)::DOUBLE AS total, avg(l_discount) AS mean_discount, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem",
        entity="lineitem", metrics=[*_F(("COUNT", "l_quantity", None), ("SUM", "l_quantity", "total"), ("MIN", "l_extendedprice", None), ("MAX", "l_extendedprice", None)), {"aggregation": "AVG", "attribute": "rounded", "name": "mean_discount"}], measures=[{"name": "rounded", "formula": "l_discount"}])
request("kpi_count_text", f"SELECT {_N} FROM orders", entity="orders", metrics=[{"aggregation": "COUNT", "attribute": "o_orderstatus", "name": "n"}])
request("kpi_empty", "SELECT 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, 0.0::DOUBLE AS m, 0.0::DOUBLE AS p, 0.0::DOUBLE AS d", entity="lineitem", filters=[["<", "l_quantity", -1]], metrics=_F(("SUM", "l_quantity", "s"), ("AVG", "l_quantity", "a"), ("MAX", "l_quantity", "m"), ("P95", "l_quantity", "p"), ("STD_DEV", "l_quantity", "d")))
request("kpi_filtered_metric", "SELECT count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS finished, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS open_total FROM orders", entity="orders",
        metrics=[{"aggregation": "COUNT", "name": "finished", "filter": ["=", "o_orderstatus", "F"]}, {"aggregation": "SUM", "attribute": "o_totalprice", "name": "open_total", "filter": ["=", "o_orderstatus", "O"]}])
_RANK = "list_sort(list({x}))[cast(least(floor({p} * count({x})), count({x}) - 1) AS INT) + 1]"
request("kpi_percentiles", "SELECT " + ", ".join(f"{_RANK.format(x='value', p=p)} AS {n}" for n, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " FROM events", entity="events", metrics=_F(("MEDIAN", "value", "median"), ("P90", "value", "p90"), ("P95", "value", "p95"), ("P99", "value", "p99")))
request("table_percentile", f"SELECT event_type, {_RANK.format(x='value', p=0.9)} AS p90 FROM events GROUP BY event_type", entity="events", dimensions=["event_type"], metrics=_F(("P90", "value", "p90")))
request("kpi_stddev_var", "SELECT stddev_samp(l_quantity) AS std_dev_l_quantity, var_samp(l_quantity) AS variance_l_quantity FROM lineitem", entity="lineitem", metrics=_F(("STD_DEV", "l_quantity", None), ("VARIANCE", "l_quantity", None)))
request("kpi_corr_slope", "SELECT corr(l_extendedprice, l_quantity) AS r, regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem", entity="lineitem",
        metrics=[{"aggregation": "CORRELATION", "attribute": "l_extendedprice", "secondary": "l_quantity", "name": "r"}, {"aggregation": "LINEAR_REGRESSION", "attribute": "l_extendedprice", "secondary": "l_quantity", "name": "slope"}])
request("kpi_count_distinct", "SELECT count(DISTINCT o_custkey)::DOUBLE AS customers, count(DISTINCT o_orderpriority)::DOUBLE AS priorities FROM orders", entity="orders", metrics=_F(("COUNT_DISTINCT", "o_custkey", "customers"), ("COUNT_DISTINCT", "o_orderpriority", "priorities")))
request("pie_by_dim", f"SELECT c_mktsegment, {_N}, sum(c_acctbal) AS balance FROM customer WHERE c_mktsegment <> '' GROUP BY c_mktsegment", entity="customer", cast="PIE", dimensions=["c_mktsegment"], metrics=[*_COUNT, *_F(("SUM", "c_acctbal", "balance"))])
request("bubble_two_dims", "SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n, avg(o_totalprice) AS mean FROM orders GROUP BY ALL", entity="orders", cast="BUBBLE", dimensions=["o_orderstatus", "o_orderpriority"], metrics=[*_COUNT, *_F(("AVG", "o_totalprice", "mean"))])
request("table_groupby", "SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL", entity="lineitem",
        filters=[["<=", "l_shipdate", "1998-09-02"]], dimensions=["l_returnflag", "l_linestatus"], metrics=[*_COUNT, *_F(("SUM", "l_quantity", "sum_qty"), ("AVG", "l_extendedprice", "avg_price"))], sort=[{"field": "l_returnflag"}])
request("table_sorted_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'", entity="orders", filters=[["=", "o_orderstatus", "P"]], select=["o_orderkey", "o_totalprice"], sort=[{"field": "o_totalprice", "descending": True}])
request("table_page2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20", entity="orders", sort=[{"field": "o_totalprice", "descending": True}], cursor="MjA6MjA=", select=["o_orderkey", "o_totalprice"])
request("csv_cast", "SELECT c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1", entity="customer", cast="CSV", dimensions=["c_mktsegment"], metrics=_COUNT)
request("ts_day", "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS n, sum(value) AS total FROM events GROUP BY 1", entity="events", dimensions=[{"attribute": "ts", "interval": "day"}], metrics=[*_COUNT, *_F(("SUM", "value", "total"))])
request("ts_week_by_type", "SELECT date_trunc('week', ts)::TIMESTAMP AS ts, event_type, sum(value) AS total FROM events GROUP BY 1, 2", entity="events", dimensions=[{"attribute": "ts", "interval": "week"}, "event_type"], metrics=_F(("SUM", "value", "total")))
request("ts_quarter", "SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS o_orderdate, count(*)::DOUBLE AS n FROM orders GROUP BY 1", entity="orders", dimensions=[{"attribute": "o_orderdate", "interval": "quarter"}], metrics=_COUNT)
request("ts_day_in_zone", "SELECT (date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Bogota') AT TIME ZONE 'America/Bogota') AT TIME ZONE 'UTC' AS ts, count(*)::DOUBLE AS n FROM events GROUP BY 1", entity="events", time_frame={"type": "ALL_TIME", "timezone": "America/Bogota"}, dimensions=[{"attribute": "ts", "interval": "day"}], metrics=_COUNT)
request("ts_gapfill", """WITH rows AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS t, o_orderpriority AS p, o_totalprice AS v FROM orders WHERE o_totalprice > 190000),
    ends AS (SELECT p, min(t) AS lo, max(t) AS hi FROM rows GROUP BY p), times AS (SELECT p, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS t FROM ends),
    sums AS (SELECT t, p, count(*)::DOUBLE AS n, avg(v) AS mean FROM rows GROUP BY ALL)
    SELECT t::TIMESTAMP AS o_orderdate, p AS o_orderpriority, coalesce(n, 0.0) AS n, mean FROM times LEFT JOIN sums USING (t, p)""", entity="orders", filters=[[">", "o_totalprice", 190000]], fill_gaps=True,
        dimensions=[{"attribute": "o_orderdate", "interval": "month"}, "o_orderpriority"], metrics=[*_COUNT, *_F(("AVG", "o_totalprice", "mean"))])
_FRAMES = {"last_week": ("LAST_WEEK", 1, "2024-01-22", "2024-01-29"), "last_7_days": ("LAST_N_DAYS", 7, "2024-01-24", "2024-01-31"), "month_to_date": ("MONTH_TO_DATE", 1, "2024-01-01", "2024-01-31"), "yesterday": ("YESTERDAY", 1, "2024-01-30", "2024-01-31"), "last_48_hours": ("LAST_N_HOURS", 48, "2024-01-29", "2024-01-31")}
for _n, (_t, _k, _lo, _hi) in _FRAMES.items():
    request(f"frame_{_n}", f"SELECT {_N} FROM events WHERE ts BETWEEN TIMESTAMP '{_lo}' AND TIMESTAMP '{_hi}'", entity="events", time_frame={"type": _t, "n": _k}, metrics=_COUNT)

# formulas

request("measure_formula", "SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge FROM lineitem GROUP BY 1", entity="lineitem", measures=[{"name": "charge_row", "formula": "l_extendedprice * (1 - l_discount) * (1 + l_tax)"}], dimensions=["l_returnflag"], metrics=_F(("SUM", "charge_row", "charge")))
request("measure_nullsafe_div", "SELECT count(CASE WHEN l_tax <> 0 THEN 1 END)::DOUBLE AS n, avg(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END) AS ratio FROM lineitem", entity="lineitem", measures=[{"name": "r", "formula": "l_discount / l_tax"}], metrics=_F(("COUNT", "r", "n"), ("AVG", "r", "ratio")))
request("measure_functions", """SELECT p_partkey, CASE WHEN p_size > 25 THEN greatest(p_retailprice, 1200.0) ELSE least(p_retailprice, 1200.0) END AS f1, least(greatest(p_retailprice, 950.0), 1500.0) AS f2, ln(p_size) + log10(p_retailprice) + sqrt(p_size) AS f3, floor(p_retailprice / 7 + 0.5) AS f4, p_size % 7 + p_size ^ 2 AS f5 FROM part""",
        entity="part", measures=[{"name": "big", "formula": "GREATEST(SIGN(p_size - 25), 0)"}, {"name": "f1", "formula": "IF(big, GREATEST(p_retailprice, 1200), LEAST(p_retailprice, 1200))"}, {"name": "f2", "formula": "CLAMP(p_retailprice, 950, 1500)"}, {"name": "f3", "formula": "LOG(p_size) + LOG10(p_retailprice) + SQRT(p_size)"}, {"name": "f4", "formula": "ROUND(p_retailprice / 7)"}, {"name": "f5", "formula": "MOD(p_size, 7) + p_size ^ 2"}], select=["p_partkey", "f1", "f2", "f3", "f4", "f5"])
request("measure_precedence", "SELECT max(2 + 3 * 4 - 6 / 3)::DOUBLE AS a, max(4.0)::DOUBLE AS b, max(512.0)::DOUBLE AS c FROM region", entity="region", measures=[{"name": "a0", "formula": "2 + 3 * 4 - 6 / 3"}, {"name": "b0", "formula": "-2 ^ 2"}, {"name": "c0", "formula": "2 ^ 3 ^ 2"}], metrics=_F(("MAX", "a0", "a"), ("MAX", "b0", "b"), ("MAX", "c0", "c")))

# comparisons: every period in one scan

_IN = "ts BETWEEN TIMESTAMP '{}' AND TIMESTAMP '{}'"
_CUR, _PRE = _IN.format("2024-01-24", "2024-01-31"), _IN.format("2024-01-17", "2024-01-24")
request("compare_prev_period", f"SELECT sum(value) FILTER ({_CUR}) AS v, sum(value) FILTER ({_CUR}) AS current_v, sum(value) FILTER ({_PRE}) AS prev_0_v, sum(value) FILTER ({_PRE}) AS previous_value FROM events", entity="events",
        time_frame={"type": "LAST_N_DAYS", "n": 7}, metrics=_F(("SUM", "value", "v")), comparisons=[{"type": "TIME_SHIFT_SHORTCUT", "shortcut": "PREVIOUS_PERIOD"}])
request("compare_relative_and_absolute", f"SELECT count(*) FILTER ({_CUR})::DOUBLE AS n, count(*) FILTER ({_CUR})::DOUBLE AS current_n, count(*) FILTER ({_IN.format('2024-01-10', '2024-01-17')})::DOUBLE AS prev_0_n, count(*) FILTER ({_IN.format('2024-01-01', '2024-01-03')})::DOUBLE AS prev_1_n, count(*) FILTER ({_IN.format('2024-01-10', '2024-01-17')})::DOUBLE AS previous_value FROM events",
        entity="events", time_frame={"type": "LAST_N_DAYS", "n": 7}, metrics=_COUNT, comparisons=[{"type": "TIME_SHIFT_RELATIVE", "granularity": "week", "amount": 2}, {"type": "TIME_SHIFT_ABSOLUTE", "start_ms": 1704067200000, "end_ms": 1704240000000}])
request("compare_last_year", "SELECT count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31')::DOUBLE AS n, count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31')::DOUBLE AS current_n, count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31')::DOUBLE AS prev_0_n, count(*) FILTER (o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31')::DOUBLE AS previous_value FROM orders",
        entity="orders", time_frame={"type": "CUSTOM_RANGE", "start_ms": 852076800000, "end_ms": 883526400000}, metrics=_COUNT, comparisons=[{"type": "TIME_SHIFT_SHORTCUT", "shortcut": "SAME_PERIOD_LAST_YEAR"}])
request("compare_smart", f"WITH s AS (SELECT sum(value) FILTER ({_CUR}) AS v, avg(value) FILTER (ts BETWEEN TIMESTAMP '2023-10-26' AND TIMESTAMP '2024-01-24') AS m, stddev_samp(value) FILTER (ts BETWEEN TIMESTAMP '2023-10-26' AND TIMESTAMP '2024-01-24') AS d FROM events) SELECT v, m AS mean_v, d AS std_v, (v - m) / d AS z_score_v FROM s",
        entity="events", time_frame={"type": "LAST_N_DAYS", "n": 7}, metrics=_F(("SUM", "value", "v")), comparisons=[{"type": "SMART"}])
request("benchmark", "SELECT avg(o_totalprice) AS v, 250.0::DOUBLE AS benchmark_goal, 250.0::DOUBLE AS previous_value FROM orders", entity="orders", metrics=_F(("AVG", "o_totalprice", "v")), comparisons=[{"type": "BENCHMARK", "label": "goal", "value": 250}])


@query(f"WITH s AS (SELECT sum(value) FILTER ({_CUR}) AS c, sum(value) FILTER ({_PRE}) AS p FROM events) SELECT c - p AS delta, 100 * (c - p) / abs(p) AS pct, CASE WHEN c - p > 0.001 THEN 'up' WHEN c - p < -0.001 THEN 'down' ELSE 'flat' END AS direction FROM s", doubles="delta pct")
def intelligence_signal(spark, sf_dir):
    got = engine(spark, sf_dir).run({"entity": "events", "time_frame": {"type": "LAST_N_DAYS", "n": 7}, "metrics": _F(("SUM", "value", "v")), "comparisons": [{"type": "TIME_SHIFT_SHORTCUT"}]}).whole
    return intelligence(got, "v", "previous_value").select("delta", "pct", "direction")


# relations

request("semi_join_dotpath", f"SELECT {_N} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", entity="orders", filters=[{"field": "o_custkey.c_mktsegment", "op": "EQ", "value": "BUILDING"}], metrics=_COUNT)
request("semi_join_in_tree", f"SELECT {_N} FROM orders WHERE o_totalprice > 50000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", entity="orders", filters=[{"conjunction": "AND", "nodes": [{"field": "o_totalprice", "op": "GT", "value": 50000}, {"field": "o_custkey.c_acctbal", "op": "LT", "value": 0}]}], metrics=_COUNT)


@query("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def nested_relation(spark, sf_dir):
    got = engine(spark, sf_dir).run({"entity": "customer", "select": {"c_custkey": True, "c_nationkey": {"n_name": True, "n_regionkey": {"r_name": True}}}}).whole
    return got.select("c_custkey", F.col("c_nationkey.n_name").alias("nation"), F.col("c_nationkey.n_regionkey.r_name").alias("region"))


@query("SELECT DISTINCT lang AS value FROM documents WHERE lang <> '' ORDER BY 1")
def explore_distinct(spark, sf_dir):
    return explore(load_table(spark, sf_dir, "documents"), "lang")


@query("SELECT o_orderkey AS id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') > 25 AS truncated FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY 1 LIMIT 25")
def list_truncated(spark, sf_dir):
    ids, cut = list_ids(load_table(spark, sf_dir, "orders"), "o_orderkey", {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"}, 25)
    return ids.withColumn("truncated", F.lit(cut))


@query()
def discovery(spark, sf_dir):
    return REGISTRY.discovery(spark)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'live' ELSE n_name END AS n_name FROM nation")
def row_overlay(spark, sf_dir):
    base = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return overlay(base, base.where("n_nationkey % 3 = 0").select("n_nationkey", F.lit("live").alias("n_name")), "n_nationkey", ["n_name"])


@query("SELECT e.event_id, x.hook FROM events e JOIN (VALUES ('click', 'a'), ('click', 'b'), ('error', 'b')) x(t, hook) ON e.event_type = x.t")
def rule_routing(spark, sf_dir):
    rules = load_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule_id"))
    hooks = spark.createDataFrame([("a", True, ["click"]), ("b", True, ["click", "error", "error"]), ("c", False, ["click"])], "hook_id string, active boolean, subscribed_rule_ids array<string>")
    subscribed = route(rules.select("rule_id").distinct(), hooks)
    return rules.join(subscribed, "rule_id").select("event_id", F.col("hook_id").alias("hook"))


# hierarchies over parts: the parent of part p is p // 4

_TREE = "tree AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 1 THEN greatest(p_partkey // 4, 1) END AS up, p_retailprice AS v FROM part)"
_REACH = f"WITH RECURSIVE {_TREE}, reach AS (SELECT k AS node, k AS ancestor, 0 AS depth FROM tree UNION ALL SELECT r.node, t.up, r.depth + 1 FROM reach r JOIN tree t ON t.k = r.ancestor WHERE t.up IS NOT NULL)"


def _tree(spark, sf_dir):
    key = F.col("p_partkey")
    return load_table(spark, sf_dir, "part").select(key.alias("k"), F.when(key > 1, F.greatest((key / 4).cast("long"), F.lit(1))).alias("up"), F.col("p_retailprice").alias("v"))


@query(f"WITH {_TREE} SELECT k, EXISTS (SELECT 1 FROM tree c WHERE c.up = t.k) AS has_children FROM tree t WHERE up IS NULL OR up = 1")
def has_children(spark, sf_dir):
    from halyard.operators.relations import with_has_children

    t = _tree(spark, sf_dir)
    return with_has_children(t.where("up is null or up = 1"), t, "k", "up").select("k", "has_children")


@query(f"{_REACH} SELECT node, ancestor, depth FROM reach")
def hierarchy_closure(spark, sf_dir):
    return closure(_tree(spark, sf_dir), "k", "up")


@query(f"{_REACH} SELECT node AS k, depth FROM reach WHERE ancestor = 5")
def subtree_closure(spark, sf_dir):
    return subtree(_tree(spark, sf_dir), "k", "up", 5)


@query(f"{_REACH} SELECT ancestor AS k, sum(l_quantity) AS total, count(DISTINCT node) AS nodes FROM reach LEFT JOIN lineitem ON l_partkey = node GROUP BY ancestor".replace("sum(l_quantity)", "coalesce(sum(l_quantity), 0)"), doubles="total")
def hierarchy_roll_up(spark, sf_dir):
    return roll_up(_tree(spark, sf_dir), load_table(spark, sf_dir, "lineitem"), "k", "up", "l_partkey", "l_quantity")


@query(f"{_REACH}, own AS (SELECT k, CASE WHEN k % 7 = 0 OR k = 1 THEN v END AS a FROM tree) SELECT node AS k, arg_min(a, depth) AS a FROM reach JOIN own ON own.k = ancestor WHERE a IS NOT NULL GROUP BY node", doubles="a")
def inherited_attribute(spark, sf_dir):
    t = _tree(spark, sf_dir).withColumn("a", F.expr("CASE WHEN k % 7 = 0 OR k = 1 THEN v END"))
    return inherited(t, "k", "up", "a").select("k", "a")


@query(f"{_REACH} SELECT ancestor AS k, count(*) AS below FROM reach GROUP BY ancestor")
def euler_intervals(spark, sf_dir):
    e = euler(_tree(spark, sf_dir), "k", "up")
    inner, outer = e.select(F.col("tin").alias("x")), e.select("k", "tin", "tout")
    return interval_join(inner, "x", outer, "tin", "tout", 64).groupBy("k").agg(F.count("*").alias("below"))


# security, labels, output

_SECURED = Registry([EntityModel("events", (Attribute("event_id", "long"), Attribute("user_id", "long"), Attribute("event_type", "enum"), Attribute("value", "double"), Attribute("props", "json", sensitive=True), Attribute("tenant", "long"), Attribute("helper", "long")), "event_id", time="ts", tenant="tenant", owner="user_id", assignees="helper", location="event_type")])


def _secured(spark, sf_dir) -> Engine:
    load = lambda name: load_table(spark, sf_dir, name).withColumn("tenant", F.col("user_id") % 3).withColumn("helper", F.col("event_id") % 150)
    return Engine(spark, _SECURED, load, NOW)


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 = 1 AND (user_id = 7 OR event_id % 150 = 7)")
def rls_own_or_assigned(spark, sf_dir):
    return _secured(spark, sf_dir).run({"entity": "events", "select": ["event_id", "user_id"]}, Security(tenant=1, user=7, scopes=("OWN", "ASSIGNED"))).whole


@query("SELECT event_type, count(*)::DOUBLE AS n FROM events WHERE user_id % 3 = 2 AND event_type IN ('click', 'view') GROUP BY 1", doubles="n")
def rls_locations(spark, sf_dir):
    return _secured(spark, sf_dir).run({"entity": "events", "dimensions": ["event_type"], "metrics": _COUNT}, Security(tenant=2, locations=("click", "view"))).whole


@query("SELECT event_id, value FROM events WHERE false", doubles="value")
def rls_none(spark, sf_dir):
    return _secured(spark, sf_dir).run({"entity": "events", "select": ["event_id", "value"]}, Security(tenant=2, scopes=("NONE",))).whole


@query("SELECT event_id, ts, user_id, event_type, value, user_id % 3 AS tenant, event_id % 150 AS helper FROM events WHERE user_id % 3 = 0 AND value > 90", doubles="value")
def redaction(spark, sf_dir):
    return _secured(spark, sf_dir).run({"entity": "events", "filters": [[">", "value", 90]]}, Security(tenant=0)).whole


request("label_template", "SELECT p_brand || ' / ' || p_size::VARCHAR AS p_brand, count(*)::DOUBLE AS n FROM part GROUP BY 1", entity="part", dimensions=[{"attribute": "p_brand", "label_template": "{{p_brand}} / {{part/p_size}}"}], metrics=_COUNT)


request("label_join", "SELECT n_name || ' in ' || r_name AS n_regionkey, count(*)::DOUBLE AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1", entity="nation", dimensions=[{"attribute": "n_regionkey", "label_template": "{{n_name}} in {{n_regionkey.r_name}}"}], metrics=_COUNT)


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_operations(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    of = lambda c, v: o.where(F.col(c) == v).select("o_custkey")
    return same_rows(same_rows(of("o_orderstatus", "F"), of("o_orderstatus", "O"), "intersect"), of("o_orderpriority", "1-URGENT"), "except")


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS n FROM events GROUP BY 1")
def bitmap_distinct(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    parts = row_bitmaps(e.where("event_id % 2 = 0"), "user_id", ["event_type"]).unionByName(row_bitmaps(e.where("event_id % 2 = 1"), "user_id", ["event_type"]))
    return bitmap_cardinality(parts, ["event_type"])


@query()
def metric_logistic(spark, sf_dir):
    body = {"entity": "orders", "measures": [{"name": "scaled", "formula": "o_totalprice / 100000"}, {"name": "big", "formula": "GREATEST(SIGN(o_totalprice - 150000 + MOD(o_orderkey, 7) * 10000), 0)"}], "dimensions": ["o_orderpriority"], "metrics": [{"aggregation": "LOGISTIC_REGRESSION", "attribute": "big", "secondary": "scaled", "name": "slope"}]}
    return engine(spark, sf_dir).run(body).whole


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') THEN '''' || v ELSE v END AS v, n FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' || lang WHEN 1 THEN '-' || source ELSE source END AS v, n_chars::VARCHAR AS n FROM documents)")
def csv_sanitize(spark, sf_dir):
    v = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), "source")).otherwise(F.col("source"))
    return safe_cells(load_table(spark, sf_dir, "documents").select("doc_id", v.alias("v"), F.col("n_chars").cast("double").alias("n")))


@query("SELECT coalesce(a.ts, b.ts) AS ts, a.n AS clicks_n, b.n AS errors_n FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS n FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.ts = b.ts", doubles="clicks_n errors_n")
def multi_series(spark, sf_dir):
    e = engine(spark, sf_dir)
    part = lambda kind: e.run({"entity": "events", "filters": [["=", "event_type", kind]], "dimensions": [{"attribute": "ts", "interval": "hour"}], "metrics": _COUNT}).whole
    return merge_series({"clicks": part("click"), "errors": part("error")}, ["ts"])


@query()
def search_fuzzy(spark, sf_dir):
    return engine(spark, sf_dir).run({"entity": "customer", "search": "Custmoer#000000017", "select": ["c_custkey", "c_name"]}).whole


@query("SELECT user_id, sum((props::JSON ->> '$.k')::INT)::BIGINT AS k FROM events GROUP BY 1")
def json_attribute(spark, sf_dir):
    return load_table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a filtered, grouped request over lineitem with a formula measure."""
    e = Engine(spark, REGISTRY, loader(spark, sf_dir), NOW)
    return e.run({"entity": "lineitem", "filters": [["<=", "l_shipdate", "1998-09-02"]], "measures": [{"name": "net", "formula": "l_extendedprice * (1 - l_discount)"}], "dimensions": ["l_returnflag", "l_linestatus"],
                  "metrics": [*_COUNT, *_F(("SUM", "l_quantity", "sum_qty"), ("SUM", "net", "sum_net"), ("AVG", "l_discount", "avg_disc"), ("P90", "l_extendedprice", "p90_price"))]}).whole
