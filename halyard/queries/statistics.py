"""Statistics, series, reliability, geography and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.functions import stats as S
from halyard.operators import geo as G
from halyard.operators import timeseries as T
from halyard.queries.registry import query
from halyard.sources.tables import load_table


def _events(spark, sf_dir):
    return load_table(spark, sf_dir, "events")


_POP = "avg({x}) AS mu, var_pop({x}) AS m2, count({x}) AS n"


@query("WITH s AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY 1), m AS (SELECT event_type, count(value)::BIGINT AS n, any_value(mu) AS mean, var_samp(value) AS variance, stddev_samp(value) AS std, stddev_samp(value) / any_value(mu) AS cv, avg((value - mu) ^ 3) / var_pop(value) ^ 1.5 AS skewness, kurtosis_pop(value) AS kurtosis FROM events JOIN s USING (event_type) GROUP BY 1) SELECT *, n / 6 * (skewness ^ 2 + kurtosis ^ 2 / 4) AS jarque_bera FROM m", doubles="mean variance std cv skewness kurtosis jarque_bera")
def moments(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(*(c.alias(n) for n, c in S.moments(F.col("value")).items()))


@query("SELECT event_type, exp(sum(ln(CASE WHEN value > 0 THEN value END)) / count(value)) AS geometric, count(value) / sum(1 / CASE WHEN value > 0 THEN value END) AS harmonic, sqrt(avg(value * value)) AS rms, max(abs(value)) / sqrt(avg(value * value)) AS crest FROM events GROUP BY 1", doubles="geometric harmonic rms crest")
def means(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(*(c.alias(n) for n, c in S.means(F.col("value")).items()))


@query("SELECT event_type, quantile_cont(value, 0.001) AS q0001, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.975) AS q975, quantile_cont(value, 0.9999) AS q9999 FROM events GROUP BY 1", doubles="q0001 q25 q50 q975 q9999")
def robust_quantiles(spark, sf_dir):
    q = _events(spark, sf_dir).groupBy("event_type").agg(S.quantiles(F.col("value")).alias("q"))
    at = {p: i for i, p in enumerate(S.QUANTILES)}
    return q.select("event_type", *(F.col("q")[at[p]].alias(n) for n, p in (("q0001", 0.001), ("q25", 0.25), ("q50", 0.5), ("q975", 0.975), ("q9999", 0.9999))))


_ROBUST = "q AS (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.95) AS b FROM events GROUP BY 1), m AS (SELECT event_type, quantile_cont(abs(value - median), 0.5) AS mad, avg(value) FILTER (value BETWEEN a AND b) AS trimmed_mean FROM events JOIN q USING (event_type) GROUP BY 1)"


@query(f"WITH {_ROBUST} SELECT event_type, median, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence, mad, trimmed_mean FROM q JOIN m USING (event_type)", doubles="median q1 q3 iqr low_fence high_fence mad trimmed_mean")
def robust_summary(spark, sf_dir):
    return S.robust(_events(spark, sf_dir), "value", ["event_type"])


@query(f"WITH {_ROBUST} SELECT event_id, 0.6745 * abs(value - median) / mad AS modified_z FROM events JOIN q USING (event_type) JOIN m USING (event_type) WHERE 0.6745 * abs(value - median) / mad > 1.2", doubles="modified_z")
def mad_outliers(spark, sf_dir):
    return S.outliers(_events(spark, sf_dir), "value", ["event_type"], 1.2).select("event_id", "modified_z")


@query("SELECT user_id, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY 1", doubles="first last")
def first_last(spark, sf_dir):
    return T.first_last(_events(spark, sf_dir), ["user_id"], "ts", "value")


@query("WITH s AS (SELECT user_id, value AS x, avg(value) OVER (PARTITION BY user_id) AS m, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*)::BIGINT AS n, sum((x - m) * (x1 - m)) / sum((x - m) ^ 2) AS acf1, sum((x - m) * (x2 - m)) / sum((x - m) ^ 2) AS acf2, sum((x - x1) ^ 2) / sum((x - m) ^ 2) AS durbin_watson, count(*) FILTER ((x >= m) <> (x1 >= m)) / (count(*) - 1) AS zero_crossing FROM s GROUP BY 1", doubles="acf1 acf2 durbin_watson zero_crossing")
def acf_dw(spark, sf_dir):
    return T.autocorrelation(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")


@query("SELECT event_type, regr_slope(value, epoch(ts)) * 86400 AS per_day, corr(value, epoch(ts)) AS r FROM events GROUP BY 1", doubles="per_day r")
def drift(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return T.drift(_events(spark, sf_dir), ["event_type"], seconds, "value").select("event_type", (F.col("slope") * 86400).alias("per_day"), "r")


@query("WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS xs FROM events GROUP BY 1) SELECT user_id, list_reduce(xs, lambda a, x: 0.25 * x + 0.75 * a) AS ema_fast, list_reduce(xs, lambda a, x: 0.05 * x + 0.95 * a) AS ema_slow, list_reduce(xs, lambda a, x: 0.25 * x + 0.75 * a) - list_reduce(xs, lambda a, x: 0.05 * x + 0.95 * a) AS macd FROM s", doubles="ema_fast ema_slow macd")
def ema(spark, sf_dir):
    return T.ema(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")


@query("""WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id) AS z FROM events),
    c AS (SELECT user_id, k, greatest(0, z - 0.5)::DOUBLE AS up, greatest(0, -z - 0.5)::DOUBLE AS down FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.k, greatest(0, c.up + s.z - 0.5), greatest(0, c.down - s.z - 0.5) FROM c JOIN s ON s.user_id = c.user_id AND s.k = c.k + 1)
    SELECT user_id, max(up) AS cusum_up, max(down) AS cusum_down, greatest(max(up), max(down)) > 5 AS alarm FROM c GROUP BY 1""", doubles="cusum_up cusum_down")
def cusum(spark, sf_dir):
    return T.cusum(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events", doubles="running")
def rolling_prefix_sum(spark, sf_dir):
    return T.prefix_sum(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_id", "running")


@query("SELECT coalesce(sum(value), 0) AS total FROM events WHERE event_id BETWEEN 1000 AND 4000", doubles="total")
def range_sum(spark, sf_dir):
    return T.range_sum(_events(spark, sf_dir), "event_id", 1000, 4000, "value")


_PYRAMID = "SELECT event_type, date_trunc('{}', ts)::TIMESTAMP AS bucket, count(value)::BIGINT AS n, sum(value) AS sum, min(value) AS min, max(value) AS max, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY 1, 2"


@query(_PYRAMID.format("hour"), doubles="sum min max first last")
def pyramid_1h(spark, sf_dir):
    return T.pyramid(_events(spark, sf_dir), "event_type", "ts", "value", "1h")


@query(_PYRAMID.format("day"), doubles="sum min max first last")
def pyramid_rolled_1d(spark, sf_dir):
    return T.roll_pyramid(T.pyramid(_events(spark, sf_dir), "event_type", "ts", "value", "1m"), "event_type", "1d")


@query("WITH a AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) - lag(epoch(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d1 FROM orders), b AS (SELECT o_custkey, d1 - lag(d1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d2 FROM a) SELECT o_custkey, coalesce(count(*) FILTER (d2 = 0) / nullif(count(d2), 0), 0)::DOUBLE AS zero_ratio FROM b GROUP BY 1", doubles="zero_ratio")
def delta_of_delta(spark, sf_dir):
    return T.steady_steps(load_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], F.unix_seconds(F.col("o_orderdate").cast("timestamp")))


@query()
def spectrum(spark, sf_dir):
    return T.spectrum(_events(spark, sf_dir), "user_id", "ts", "value", 1.0)


@query()
def goertzel(spark, sf_dir):
    return T.goertzel(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 0.1, 1.0)


def _one_row(spark, **values: float):
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


@query("SELECT corr(l_quantity, l_extendedprice) AS qp, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS pd FROM lineitem", doubles="qp qd pd")
def pearson_matrix(spark, sf_dir):
    m = S.pearson_matrix(load_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return _one_row(spark, qp=m[0, 1], qd=m[0, 2], pd=m[1, 2])


@query("""WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS d, covar_pop(l_quantity, l_extendedprice) AS e, covar_pop(l_discount, l_extendedprice) AS f, var_pop(l_extendedprice) AS v, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS mp FROM lineitem),
    s AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS bq, (a * f - b * e) / (a * d - b * b) AS bd FROM c) SELECT bq AS l_quantity, bd AS l_discount, mp - bq * mq - bd * md AS intercept, (bq * e + bd * f) / v AS r2 FROM s""", doubles="l_quantity l_discount intercept r2")
def ols_two_features(spark, sf_dir):
    return _one_row(spark, **S.ols(load_table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))


@query()
def principal_component(spark, sf_dir):
    v, share = S.principal_component(load_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return _one_row(spark, w0=v[0], w1=v[1], w2=v[2], share=share)


@query("""WITH c AS (SELECT var_samp(p_size) + 1e-6 AS a, covar_samp(p_size, p_retailprice) AS b, var_samp(p_retailprice) + 1e-6 AS d, avg(p_size) AS ms, avg(p_retailprice) AS mr FROM part)
    SELECT p_partkey, sqrt((d * (p_size - ms) ^ 2 - 2 * b * (p_size - ms) * (p_retailprice - mr) + a * (p_retailprice - mr) ^ 2) / (a * d - b * b)) AS distance FROM part, c""", doubles="distance")
def mahalanobis(spark, sf_dir):
    return S.mahalanobis(load_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).select("p_partkey", "distance")


@query("WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::DOUBLE AS rx, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::DOUBLE AS ry FROM events) SELECT event_type, corr(rx, ry) AS spearman FROM r GROUP BY 1", doubles="spearman")
def spearman(spark, sf_dir):
    return S.spearman(_events(spark, sf_dir), "value", "ts", ["event_id"], ["event_type"])


@query()
def logistic_irls(spark, sf_dir):
    b0, b1, steps = S.logistic(load_table(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int")).withColumn("x", F.col("o_totalprice") / 1e5), "x", "y")
    return _one_row(spark, intercept=b0, slope=b1, steps=steps)


@query("WITH d AS (SELECT left(replace(replace((abs(o_totalprice))::VARCHAR, '0.', ''), '.', ''), 1)::INT AS digit, count(*)::BIGINT AS n FROM orders WHERE o_totalprice <> 0 GROUP BY 1) SELECT digit, n, log10(1 + 1 / digit) * sum(n) OVER () AS expected FROM d", doubles="expected")
def benford(spark, sf_dir):
    return S.benford(load_table(spark, sf_dir, "orders"), "o_totalprice")


@query("WITH t AS (SELECT event_type AS from_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_state FROM events), c AS (SELECT from_state, to_state, count(*)::BIGINT AS n FROM t WHERE to_state IS NOT NULL GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM c", doubles="p")
def markov_events(spark, sf_dir):
    return S.markov(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query()
def markov_steady_state(spark, sf_dir):
    states, m = S.transition_matrix(S.markov(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type"))
    v = S.steady_state(m)
    return spark.createDataFrame([(s, round(float(p), 9), round(S.n_step(m, i, 0, 3), 9)) for i, (s, p) in enumerate(zip(states, v, strict=True))], "state string, share double, to_first_in_3 double")


# reliability: a purchase is a failure, everything else is censored

@query("WITH r AS (SELECT event_type, round(value) AS time, (user_id % 3 = 0)::INT AS f FROM events), a AS (SELECT event_type, time, sum(f) AS failures, sum(count(*)) OVER (PARTITION BY event_type ORDER BY time DESC) AS at_risk FROM r GROUP BY event_type, time) SELECT event_type, time, at_risk::BIGINT AS at_risk, failures::BIGINT AS failures, exp(sum(CASE WHEN failures < at_risk THEN ln(1 - failures / at_risk) ELSE -1e9 END) OVER (PARTITION BY event_type ORDER BY time)) AS survival FROM a WHERE failures > 0", doubles="time survival")
def kaplan_meier(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_type", F.round("value").alias("time"), (F.col("user_id") % 3 == 0).alias("failed"))
    return S.kaplan_meier(rows, "time", "failed", ["event_type"])


@query()
def weibull_fit(spark, sf_dir):
    return S.weibull_by(_events(spark, sf_dir).withColumn("failed", F.col("user_id") % 3 == 0), "event_type", "value", "failed")


@query("SELECT p_partkey, exp(-((p_retailprice / 1200) ^ 2.5)) AS survival, 2.5 / 1200 * (p_retailprice / 1200) ^ 1.5 AS hazard FROM part", doubles="survival hazard")
def weibull_reliability(spark, sf_dir):
    t, k, s = F.col("p_retailprice"), F.lit(2.5), F.lit(1200.0)
    return load_table(spark, sf_dir, "part").select("p_partkey", S.weibull_survival(t, k, s).alias("survival"), S.weibull_hazard(t, k, s).alias("hazard"))


@query("SELECT event_type, count(*)::BIGINT AS failures, avg(value) AS mttr, avg(value * 3) + avg(value) AS mtbf, avg(value * 3) AS mttf, sum(value * 3) / (sum(value * 3) + sum(value)) AS availability FROM events GROUP BY 1", doubles="mttr mtbf mttf availability")
def renewal_kpis(spark, sf_dir):
    return S.renewal_kpis(_events(spark, sf_dir).withColumn("up", F.col("value") * 3), "up", "value", ["event_type"])


@query("SELECT p_partkey, sqrt(2 * p_size * 50 / (p_retailprice * 0.1)) AS eoq, 1.65 * p_size * sqrt(9) AS safety, p_size * 9 + 1.65 * p_size * sqrt(9) AS reorder FROM part", doubles="eoq safety reorder")
def inventory_policy(spark, sf_dir):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    safety = S.safety_stock(1.65, size, F.lit(9.0))
    return load_table(spark, sf_dir, "part").select("p_partkey", S.eoq(size, F.lit(50.0), price * 0.1).alias("eoq"), safety.alias("safety"), S.reorder_point(size, F.lit(9.0), safety).alias("reorder"))


@query()
def normal_cdf(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", S.normal_cdf((F.col("p_size") - 25) / 10.0).alias("p"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_retailprice * 5 / 9 - 160 / 9 WHEN 1 THEN p_retailprice * 0.3048 ELSE p_retailprice END AS base FROM part", doubles="base")
def unit_conversion(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("F", "ft", "parsec"))), F.col("p_size") % 3 + 1)
    return load_table(spark, sf_dir, "part").select("p_partkey", S.to_base(F.col("p_retailprice"), unit).alias("base"))


@query("SELECT event_type, count(value)::BIGINT AS n, 0::BIGINT AS nulls, avg(value) AS mean, var_samp(value) AS variance, min(value) AS low, max(value) AS high FROM events GROUP BY 1", doubles="mean variance low high")
def synopsis_merge(spark, sf_dir):
    blocks = S.synopsis(_events(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 500)), "value", ["event_type", "block"])
    return S.merge_synopses(blocks, ["event_type"]).drop("distinct")


@query("SELECT count(*)::BIGINT AS n, avg(value) AS mean FROM events WHERE event_id // 500 IN (SELECT event_id // 500 FROM events GROUP BY 1 HAVING max(value) >= 490)", doubles="mean")
def synopsis_pruned(spark, sf_dir):
    blocks = S.synopsis(_events(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 500)), "value", ["block"])
    return S.merge_synopses(S.pruned(blocks, low=490)).select("n", "mean")


# geography: customers on a made-up grid

_PLACE = "(c_custkey * 7919 % 10000) / 10000 * 2 + 4 AS lat, (c_custkey * 104729 % 10000) / 10000 * 2 - 75 AS lon"
_HAVERSINE = "2 * 6371000 * asin(sqrt(least(1, sin(radians({b}.lat - {a}.lat) / 2) ^ 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ^ 2)))"


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    return load_table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 10000 / 10000 * 2 + 4).alias("lat"), (k * 104729 % 10000 / 10000 * 2 - 75).alias("lon"))


@query(f"WITH p AS (SELECT c_custkey AS id, {_PLACE} FROM customer), c AS (SELECT 5.0 AS lat, -74.0 AS lon) SELECT id, {_HAVERSINE.format(a='c', b='p')} AS distance FROM p, c WHERE {_HAVERSINE.format(a='c', b='p')} <= 30000", doubles="distance")
def geofence(spark, sf_dir):
    return G.geofence(_places(spark, sf_dir), "lat", "lon", (5.0, -74.0), 30000).select("id", "distance")


@query(f"WITH p AS (SELECT c_custkey AS id, {_PLACE} FROM customer), q AS (SELECT * FROM p) SELECT p.id AS a, q.id AS b FROM p JOIN q ON {_HAVERSINE.format(a='p', b='q')} <= 6000")
def geo_distance_join(spark, sf_dir):
    p = _places(spark, sf_dir)
    return G.distance_join(p, p, 6000).select("a", "b")


@query()
def dbscan(spark, sf_dir):
    return G.dbscan(_places(spark, sf_dir), 4000, 4)


@query()
def cell_ids(spark, sf_dir):
    return _places(spark, sf_dir).select("id", G.cell_id(F.col("lat"), F.col("lon")).alias("cell"), G.cluster_key(F.col("id"), F.col("id") * 3, F.col("id") * 5).alias("key"))
