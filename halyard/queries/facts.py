"""Facts, writes, validation, outbox and ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import datoms as D
from halyard.operators import ledger as L
from halyard.operators import outbox as O
from halyard.operators.validate import attribute_violations, reference_violations, state_violations, unique_violations
from halyard.plans.model import Attribute, EntityModel
from halyard.queries.registry import query
from halyard.sources.tables import load_table, rows_from_json

# A log made of orders: every order is created in transaction 1 + key % 50, its
# status changes in 100 + key % 50 where the key is even, its priority goes in
# 200 where the key is divisible by 5.

_KEYS = "'t1' AS tenant_id, 'orders' AS entity_type, o_orderkey::VARCHAR AS entity_id"
_LOG = f"""log AS (
    SELECT {_KEYS}, 'status' AS attr, o_orderstatus AS value, 1 + o_orderkey % 50 AS tx_id, true AS op FROM orders
    UNION ALL SELECT {_KEYS}, 'priority', o_orderpriority, 1 + o_orderkey % 50, true FROM orders
    UNION ALL SELECT {_KEYS}, 'status', o_orderstatus, 100 + o_orderkey % 50, false FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT {_KEYS}, 'status', 'X', 100 + o_orderkey % 50, true FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT {_KEYS}, 'priority', o_orderpriority, 200, false FROM orders WHERE o_orderkey % 5 = 0)"""
_LATEST = "SELECT tenant_id, entity_type, entity_id, attr, arg_max(value, (tx_id, op)) AS value, max(tx_id) AS tx_id FROM log {where} GROUP BY ALL HAVING arg_max(op, (tx_id, op))"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    d = lambda attr, value, tx, op: F.struct(F.lit(attr).alias("attr"), value.alias("value"), tx.cast("long").alias("tx_id"), F.lit(op).alias("op"))
    even, fifth = key % 2 == 0, key % 5 == 0
    first, second = key % 50 + 1, key % 50 + 100
    made = F.array_compact(F.array(
        d("status", F.col("o_orderstatus"), first, True), d("priority", F.col("o_orderpriority"), first, True),
        F.when(even, d("status", F.col("o_orderstatus"), second, False)), F.when(even, d("status", F.lit("X"), second, True)),
        F.when(fifth, d("priority", F.col("o_orderpriority"), F.lit(200), False))))
    return o.select(F.lit("t1").alias("tenant_id"), F.lit("orders").alias("entity_type"), key.cast("string").alias("entity_id"), F.explode(made).alias("d")).select("tenant_id", "entity_type", "entity_id", "d.*")


@query(f"WITH {_LOG} {_LATEST.format(where='')}")
def latest_state(spark, sf_dir):
    return D.latest(log(spark, sf_dir))


@query(f"WITH {_LOG} {_LATEST.format(where='WHERE tx_id <= 120')}")
def as_of_snapshot(spark, sf_dir):
    return D.latest(log(spark, sf_dir), 120)


@query(f"WITH {_LOG}, s AS ({_LATEST.format(where='')}) SELECT tenant_id, entity_type, entity_id, max(value) FILTER (attr = 'status') AS status, max(value) FILTER (attr = 'priority') AS priority FROM s GROUP BY ALL")
def hydrated_rows(spark, sf_dir):
    return D.wide(D.latest(log(spark, sf_dir)), {"status": "string", "priority": "string"})


@query(f"WITH {_LOG} SELECT log.*, CASE WHEN tx_id % 2 = 0 THEN 'u' || tx_id END AS user_id FROM log WHERE entity_id = '10'")
def history_timeline(spark, sf_dir):
    tx = spark.range(1, 201).where("id % 2 = 0").select(F.col("id").alias("tx_id"), F.concat(F.lit("u"), "id").alias("user_id"))
    return D.history(log(spark, sf_dir), tx, "10")


_AFTER = f"after AS (SELECT {_KEYS}, 'status' AS attr, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS value FROM orders UNION ALL SELECT {_KEYS}, 'note', 'new' FROM orders WHERE o_orderkey % 100 = 0)"
_BEFORE = f"before AS (SELECT {_KEYS}, 'status' AS attr, o_orderstatus AS value FROM orders)"


def _states(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    values = lambda df, **cols: D.rows_to_values(df.select("o_orderkey", *(c.alias(n) for n, c in cols.items())), "o_orderkey", "orders", "t1")
    after = values(o, status=F.when(F.col("o_orderkey") % 3 == 0, "Z").otherwise(F.col("o_orderstatus"))).unionByName(values(o.where("o_orderkey % 100 = 0"), note=F.lit("new")))
    return values(o, status=F.col("o_orderstatus")), after


@query(f"WITH {_BEFORE}, {_AFTER} SELECT tenant_id, entity_type, entity_id, attr, b.value AS before, a.value AS after FROM before b FULL JOIN after a USING (tenant_id, entity_type, entity_id, attr) WHERE b.value IS DISTINCT FROM a.value")
def change_delta(spark, sf_dir):
    return D.delta(*_states(spark, sf_dir))


@query(f"WITH {_BEFORE}, {_AFTER}, j AS (SELECT tenant_id, entity_type, entity_id, attr, b.value AS old, a.value AS new FROM after a LEFT JOIN before b USING (tenant_id, entity_type, entity_id, attr) WHERE b.value IS DISTINCT FROM a.value) SELECT tenant_id, entity_type, entity_id, attr, old AS value, 9::BIGINT AS tx_id, false AS op FROM j WHERE old IS NOT NULL UNION ALL SELECT tenant_id, entity_type, entity_id, attr, new, 9, true FROM j WHERE new IS NOT NULL")
def transaction_write(spark, sf_dir):
    before, after = _states(spark, sf_dir)
    return D.plan_write(before, after, 9)


@query(f"WITH {_LOG}, after AS (SELECT * FROM log UNION ALL SELECT tenant_id, entity_type, entity_id, attr, value, 300, false FROM ({_LATEST.format(where='')}) s WHERE entity_id IN ('1', '2', '3')) SELECT count(*)::BIGINT AS n FROM ({_LATEST.format(where='').replace('FROM log', 'FROM after')}) x")
def transaction_delete(spark, sf_dir):
    d = log(spark, sf_dir)
    state = D.latest(d)
    gone = D.plan_delete(state, state.where(F.col("entity_id").isin("1", "2", "3")), 300)
    return D.latest(D.transact(d, gone)).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <= 5 AND 5 < CASE WHEN o_orderkey % 4 = 0 THEN 3 + o_orderkey % 10 ELSE 99 END AND o_orderstatus = 'O'")
def visible_at_epoch(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").withColumn("assert_epoch", F.col("o_orderkey") % 10).withColumn("retract_epoch", F.when(F.col("o_orderkey") % 4 == 0, 3 + F.col("o_orderkey") % 10))
    return D.lookup_at(o, "o_orderstatus", "O", 5).select("o_orderkey")


# validation

_PART = EntityModel("part", (Attribute("p_partkey", "long", required=True), Attribute("p_name", "string", pattern="^[a-z]"), Attribute("p_brand", "enum", options=("Brand#1", "Brand#2", "Brand#3")), Attribute("p_size", "integer"), Attribute("p_type", "string", required=True)), "p_partkey")


@query("SELECT p_partkey, len(list_filter([CASE WHEN NOT regexp_matches(p_name, '^[a-z]') THEN 'p' END, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'b' END, CASE WHEN p_partkey % 5 = 0 THEN 's' END], lambda x: x IS NOT NULL))::BIGINT AS n FROM part")
def validation_attributes(spark, sf_dir):
    p = load_table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, "big").otherwise(F.col("p_size").cast("string")))
    return attribute_violations(p, _PART).select("p_partkey", F.size("violations").cast("long").alias("n"))


@query("SELECT o_orderkey, (CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM orders")
def validation_state(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").withColumn("closed_by", F.when(F.col("o_orderkey") % 2 == 1, "x"))
    rules = [{"type": "at_most", "field": "o_totalprice", "value": 150000}, {"type": "requires_when", "field": "closed_by", "when": "o_orderstatus", "equals": "F"}, {"type": "requires_any", "fields": ["o_orderpriority", "closed_by"]}]
    return state_violations(o, rules).select("o_orderkey", F.size("violations").cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)")
def validation_reference(spark, sf_dir):
    return reference_violations(load_table(spark, sf_dir, "orders"), "o_custkey", load_table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", ["BUILDING", "MACHINERY"]).select("o_orderkey")


@query("SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey)::BIGINT AS n FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) > 1 AND bool_or(c_custkey > 1000)")
def validation_unique(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    return unique_violations(c.where("c_custkey > 1000"), c.where("c_custkey <= 1000"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("SELECT o_orderkey::VARCHAR AS entity_id FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 0")
def validation_missing(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    state = D.rows_to_values(o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus"), "o_orderkey", "orders", "t1")
    wanted = D.rows_to_values(o.where("o_orderkey % 7 = 0").select("o_orderkey", "o_orderstatus"), "o_orderkey", "orders", "t1")
    return D.missing(wanted, state).select("entity_id")


@query("SELECT * FROM (VALUES (1::BIGINT, 'bolt', 3::BIGINT), (2, NULL, NULL), (3, 'nut', 7)) t(p_partkey, p_name, p_size)")
def bulk_ingest(spark, sf_dir):
    return rows_from_json(spark, ["p_partkey", "p_name", "p_size"], [[1, "bolt", 3.9], [2, None, "many"], ["3", "nut", 7]], _PART)


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 OR (event_id % 4 = 1 AND event_id % 7 < 5 AND ts <= TIMESTAMP '2024-01-15')")
def outbox_due(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.element_at(F.array(*map(F.lit, ("PENDING", "FAILED", "SENT", "PROCESSING"))), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), (F.col("event_id") % 7).alias("retry_count"), F.col("ts").alias("retry_at"))
    return O.due(e, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


@query("SELECT event_id, least(30 * 2 ^ (event_id % 9), 1800)::DOUBLE AS wait FROM events", doubles="wait")
def outbox_backoff(spark, sf_dir):
    return load_table(spark, sf_dir, "events").select("event_id", O.wait_seconds(F.col("event_id") % 9).alias("wait"))


# ledger

_D = "::DECIMAL(18,4)"


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice::DECIMAL(18,4) * l_discount::DECIMAL(18,4), 4)::DOUBLE AS m FROM lineitem", doubles="m")
def decimal_multiply(spark, sf_dir):
    return load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.mul(F.col("l_extendedprice"), F.col("l_discount")).cast("double").alias("m"))


@query("WITH x AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_quantity AS w FROM lineitem), e AS (SELECT *, 1000000.0 * w / sum(w) OVER (PARTITION BY g) AS x FROM x), f AS (SELECT *, floor(x) AS fl, 1000000 - sum(floor(x)) OVER (PARTITION BY g) AS rest FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(x - fl, 9) DESC, i) AS k FROM f) SELECT g, sum((fl + (k <= rest)::INT) / 10000)::DOUBLE AS total, max(i)::BIGINT AS n FROM r GROUP BY g", doubles="total")
def hamilton_allocation(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = load_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("i"), F.col("l_quantity").alias("w"))
    return L.allocate(rows, F.lit(100), "w", "i", ["g"]).groupBy("g").agg(F.sum("share").cast("double").alias("total"), F.max("i").cast("long").alias("n"))


def _stock(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = li.select(F.col("l_partkey").alias("item"), k.alias("k"), F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("quantity"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("unit_cost"))
    received = rows.where("k % 3 > 0").select("item", F.col("k").alias("batch_id"), F.col("at").alias("received_at"), F.col("at").alias("expires_at"), "quantity", "unit_cost")
    issued = rows.where("k % 3 = 0").select("item", F.col("k").alias("issue_id"), F.col("at").alias("issued_at"), F.col("quantity"))
    return received, issued


_STOCK = "rows AS (SELECT l_partkey AS item, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS k, l_quantity AS q, floor(l_extendedprice / l_quantity * 100) / 100 AS c FROM lineitem), b AS (SELECT item, c, sum(q) OVER (PARTITION BY item ORDER BY k) AS hi, q FROM rows WHERE k % 3 > 0), i AS (SELECT item, k, q, sum(q) OVER (PARTITION BY item ORDER BY k) AS hi FROM rows WHERE k % 3 = 0)"


@query(f"WITH {_STOCK} SELECT i.item, i.k::BIGINT AS issue_id, any_value(i.q) AS quantity, coalesce(sum(least(i.hi, b.hi) - greatest(i.hi - i.q, b.hi - b.q)) FILTER (b.item IS NOT NULL), 0) AS filled, round(coalesce(sum((least(i.hi, b.hi) - greatest(i.hi - i.q, b.hi - b.q)) * b.c), 0), 4) AS cogs FROM i LEFT JOIN b ON i.item = b.item AND i.hi - i.q < b.hi AND b.hi - b.q < i.hi GROUP BY ALL", doubles="quantity filled cogs")
def fifo_cogs(spark, sf_dir):
    return L.issue(*_stock(spark, sf_dir), "item", "FIFO").withColumn("issue_id", F.col("issue_id").cast("long"))


@query()
def lifo_cogs(spark, sf_dir):
    return L.issue(*_stock(spark, sf_dir), "item", "LIFO")


@query()
def wac_cogs(spark, sf_dir):
    return L.issue(*_stock(spark, sf_dir), "item", "WAC")


@query("WITH r AS (SELECT l_partkey AS item, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS k, l_quantity AS q, floor(l_extendedprice / l_quantity * 100) / 100 AS c FROM lineitem) SELECT item, k::BIGINT AS batch_id, sum(q) OVER w AS running_quantity, sum(q * c) OVER w / sum(q) OVER w AS wac FROM r WHERE k % 3 > 0 WINDOW w AS (PARTITION BY item ORDER BY k)", doubles="running_quantity wac")
def running_wac(spark, sf_dir):
    received, _ = _stock(spark, sf_dir)
    return L.running_wac(received, "item").select("item", F.col("batch_id").cast("long").alias("batch_id"), "running_quantity", "wac")


@query("SELECT o_orderkey, round_even((o_totalprice::DECIMAL(18,4) * CASE o_orderpriority WHEN '1-URGENT' THEN 1.25 WHEN '2-HIGH' THEN 0.8 END::DECIMAL(18,4)), 4)::DOUBLE AS base_amount FROM orders", doubles="base_amount")
def fx_conversion(spark, sf_dir):
    rates = spark.createDataFrame([("1-URGENT", 1.25), ("2-HIGH", 0.8)], "currency string, rate double")
    return L.convert(load_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", rates).select("o_orderkey", F.col("base_amount").cast("double").alias("base_amount"))


@query("SELECT e.event_id, arg_max(f.value, f.ts) AS rate FROM events e LEFT JOIN events f ON f.user_id = e.user_id AND f.event_type = 'purchase' AND f.ts <= e.ts WHERE e.event_type = 'click' GROUP BY 1", doubles="rate")
def as_of_lookup(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    points = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    facts = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("rate"))
    from pyspark.sql import Window as W

    got = L.as_of(points, facts, ["user_id"], "ts", "rate")
    return got.join(points, ["user_id", "ts"]).select("event_id", "rate")


@query("SELECT l_orderkey AS entry, round(sum(l_extendedprice), 2) AS debit, round(sum(CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice - 1 ELSE l_extendedprice END), 2) AS credit, CASE WHEN l_orderkey % 10 = 0 THEN 'unbalanced' ELSE 'locked' END AS reason FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 10 = 0 OR min(l_shipdate) < TIMESTAMP '1995-06-01'", doubles="debit credit")
def journal_check(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    journal = li.select(F.col("l_orderkey").alias("entry"), F.col("l_extendedprice").alias("debit"), F.when(F.col("l_orderkey") % 10 == 0, F.col("l_extendedprice") - 1).otherwise(F.col("l_extendedprice")).alias("credit"), F.col("l_shipdate").alias("posted_at"))
    out = L.unbalanced(journal, "entry", "1995-06-01")
    return out.select("entry", F.round("debit", 2).alias("debit"), F.round("credit", 2).alias("credit"), "reason")


@query()
def hash_chain(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    return L.hash_chain(o, "o_custkey", ["o_orderdate", "o_orderkey"], F.concat_ws("|", "o_orderkey", "o_orderstatus"))


@query("SELECT p_partkey, round_even((p_retailprice::DECIMAL(18,4) - 100::DECIMAL(18,4)) * round_even(p_size::DECIMAL(18,4) / 64, 4)::DECIMAL(10,4), 4)::DOUBLE AS cost FROM part", doubles="cost")
def amortisation(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", L.amortise(F.col("p_retailprice"), F.lit(100), F.lit(64), F.col("p_size")).cast("double").alias("cost"))
