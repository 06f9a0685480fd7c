"""Operators against hand-made numbers."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import stats as S
from halyard.functions import text as X
from halyard.functions.vectors import cosine, embed, sign_agreement
from halyard.operators import datoms as D
from halyard.operators import geo, hierarchy, ledger, outbox, relations, search, timeseries
from halyard.sources.csv_sink import safe_cells, write_csv
from halyard.sources.tables import from_arrow, to_arrow


def test_datoms(spark):
    log = spark.createDataFrame([("t", "e", "1", "a", "x", 1, True), ("t", "e", "1", "a", "x", 2, False), ("t", "e", "1", "a", "y", 2, True), ("t", "e", "1", "b", "q", 1, True), ("t", "e", "1", "b", "q", 3, False)], D.DATOM)
    now = lambda as_of=None: {r.attr: r.value for r in D.latest(log, as_of).collect()}
    assert now() == {"a": "y"} and now(2) == {"a": "y", "b": "q"} and now(1) == {"a": "x", "b": "q"} and now(0) == {}
    assert [r.tx_id for r in D.history(log, untracked=("b",)).collect()] == [1, 2, 2]
    update = spark.createDataFrame([("t", "e", "1", "a", "z"), ("t", "e", "1", "b", None)], "tenant_id string, entity_type string, entity_id string, attr string, value string")
    assert sorted((r.attr, r.value, r.op) for r in D.plan_write(D.latest(log), update, 5).collect()) == [("a", "y", False), ("a", "z", True)]
    assert {r.attr: r.value for r in D.latest(D.transact(log, D.plan_write(D.latest(log), update, 5))).collect()} == {"a": "z"}


TREE = [(1, None), (10, 1), (20, 1), (101, 10), (1001, 101), (1002, 101), (2001, 20)]


def test_hierarchy(spark):
    t = spark.createDataFrame(TREE, "k long, up long")
    assert sorted(r.k for r in hierarchy.subtree(t, "k", "up", 10).collect()) == [10, 101, 1001, 1002]
    e = {r.k: r for r in hierarchy.euler(t, "k", "up").collect()}
    assert sorted(k for k in e if e[10].tin <= e[k].tin <= e[10].tout) == [10, 101, 1001, 1002] and e[1].tout - e[1].tin == 6
    got = {r.k: r.has_children for r in relations.with_has_children(t, t, "k", "up").collect()}
    assert got[101] and not got[1001]
    with pytest.raises(hierarchy.CycleError):
        hierarchy.closure(spark.createDataFrame([(1, 2), (2, 1)], "k long, up long"), "k", "up").count()


def test_fuzzy():
    match = lambda v, t: X.FuzzyTerm(t).matches(v)
    assert match("Bomba", "Bobma") and match("Válvula de bola", "valvula") and match("Válvula", "balbula") and match("Chiller A-01", "chiller")
    assert not match("Equipo #011", "Bomba 001") and not match("SN-2026-002", "SN-2026-001") and not match("", "x") and not match("abc", "")
    assert match("SN 2O26", "SN2026")
    assert X.osa("bomba", "bobma") == 1 and X.osa("", "abc") == 3 and X.osa("ca", "abc") == 3


def test_text_columns_agree_with_python(spark):
    words = ["Válvula", "charcoal", "Schnee", "SKF-6205", "", "aa", "Ñandú", "quince"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", X.phonetic(F.col("w")).alias("p"), X.trigrams(F.col("w")).alias("t"), X.tokens_search(F.col("w")).alias("k"), X.metaphone(F.col("w")).alias("m"), X.ngrams_2_3(F.col("w")).alias("g")).collect():
        assert r.p == X.py_phonetic(r.w) and set(r.t) == X.py_trigrams(r.w) and r.k == X.py_tokens_search(r.w) and tuple(r.m) == X.py_metaphone(r.w) and r.g == X.py_ngrams(r.w)
    assert df.select(X.fuzzy_match(F.col("w"), "valbula").alias("m")).where("m").count() == 1


def test_labels_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 45.256, 3.0, "=1+1"), (None, None, 2.5, "-x")], "name string, area double, n double, risky string")
    assert [r[0] for r in df.select(X.label("{{name}}: {{area}}/{{e/n}}", df.columns, dict(df.dtypes))).collect()] == ["a: 45.26/3", ": /2.50"]
    assert [r.risky for r in safe_cells(df).collect()] == ["'=1+1", "'-x"] and safe_cells(df).first().n == "3"
    write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert from_arrow(spark, to_arrow(df)).count() == 2


def test_regression(spark):
    rows = [(2.0 + i % 12, 100000.0 + 15000 * i % 450000) for i in range(1, 101)]
    df = spark.createDataFrame([(50000 + 80000 * a + 1.2 * b, a, b) for a, b in rows], "y double, a double, b double")
    got = S.ols(df, "y", ["a", "b"])
    assert got["intercept"] == pytest.approx(50000, abs=1) and got["a"] == pytest.approx(80000, abs=1) and got["b"] == pytest.approx(1.2, abs=1e-4) and got["r2"] == pytest.approx(1)
    v, share = S.principal_component(df, ["a", "b"])
    assert abs(v[1]) > 0.99 and share > 0.99


def test_logistic(spark):
    df = spark.createDataFrame([(float(x), int(x > 5)) for x in range(1, 11)], "x double, y int")
    b0, b1, steps = S.logistic(df, "x", "y")
    p = lambda x: 1 / (1 + math.exp(-(b0 + b1 * x)))
    assert steps <= 8 and b1 > 0.5 and b0 < -2 and p(1.5) < 0.15 and p(9.5) > 0.85
    assert S.logistic(df.where("y = 1"), "x", "y") is None


def test_weibull():
    t = np.array([4200 * (-math.log(1 - i / 61)) ** (1 / 2.85) for i in range(1, 61)] + [4300, 4450, 4600, 4800])
    shape, scale = S.weibull_fit(t, np.array([True] * 60 + [False] * 4))
    assert math.exp(-((3000 / scale) ** shape)) > 0.5 and 2 < shape < 4
    assert S.weibull_fit(t[:1], np.array([True])) is None and S.replacement_interval(1.0, 100, 1, 5) is None


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1), (4.0, 0)], "t double, f int")
    got = {r.time: r.survival for r in S.kaplan_meier(df, "t", "f").collect()}
    assert got == {1.0: pytest.approx(0.8), 2.0: pytest.approx(0.6), 3.0: pytest.approx(0.3)}


def test_spectrum(spark):
    df = spark.createDataFrame([("s", i, 4 + 0.02 * i + 3.5 * math.sin(2 * math.pi * 60 * i / 240)) for i in range(128)], "k string, i int, x double")
    r = timeseries.spectrum(df, "k", "i", "x", 240.0).first()
    assert abs(r.frequency - 60) < 2.5 and 0 <= r.entropy <= 1 and len(r.bands) == 8
    high, low = (timeseries.goertzel(df, ["k"], ["i"], "x", f, 240.0).first().power for f in (60.0, 25.0))
    assert high > 10 * low


def test_benford(spark):
    df = spark.createDataFrame([(100 * 1.15**k,) for k in range(1, 201)], "x double")
    assert S.benford_chi2(df, "x").first().conforms
    assert S.affine is not None and 46.4 * 5 / 9 - 160 / 9 == pytest.approx(8.0)


def test_markov(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate("ABABC")], "k string, i int, s string")
    states, m = S.transition_matrix(S.markov(df, "k", ["i"], "s"))
    assert states == ["A", "B", "C"] and m[2, 2] == 1 and m[1].tolist() == [0.5, 0, 0.5] and S.steady_state(m).sum() == pytest.approx(1)


def test_ledger(spark):
    b = spark.createDataFrame([("p", 1, 1, 9, 20.0, 150000.0), ("p", 2, 2, 8, 20.0, 210000.0)], "item string, batch_id int, received_at int, expires_at int, quantity double, unit_cost double")
    i = spark.createDataFrame([("p", 1, 3, 10.0), ("p", 2, 4, 50.0)], "item string, issue_id int, issued_at int, quantity double")
    cogs = lambda m: [(r.filled, r.cogs) for r in ledger.issue(b, i, "item", m).orderBy("issue_id").collect()]
    assert cogs("FIFO") == [(10, 1_500_000), (30, 5_700_000)] and cogs("FEFO")[0] == (10, 2_100_000) and cogs("LIFO")[0] == (10, 2_100_000) and cogs("WAC")[0] == (10, 1_800_000)
    last = ledger.running_wac(b, "item").orderBy(F.desc("batch_id")).first()
    assert last.book_value == 7_200_000 and last.wac == 180_000
    w = spark.createDataFrame([(0, 45.0), (1, 35.0), (2, 20.0), (3, 1 / 3)], "i int, w double")
    shares = [r.share for r in ledger.allocate(w, F.lit(100), "w", "i").orderBy("i").collect()]
    assert sum(shares) == 100 and len(shares) == 4
    cost = spark.createDataFrame([(5e8, 5e7, 45000.0, 9000.0)], "c double, s double, k double, u double")
    assert cost.select(ledger.amortise(*map(F.col, "csku"))).first()[0] == 90_000_000
    chain = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "g string, i int, c string")
    assert ledger.hash_chain(chain, "g", ["i"], F.col("c")).first().head == ledger.py_chain(["x", "y"])


def test_search(spark):
    docs = spark.createDataFrame([(1, "SKF-6205", "Válvula solenoide", "válvula de control con rodamiento SKF 6205", [1.0, 0.0]), (2, "ABB-1", "Motor eléctrico", "motor trifásico", [0.0, 1.0]), (3, "X-9", "Bomba", "bomba centrífuga", [-1.0, 0.1])], "doc_id long, code string, title string, description string, embedding array<float>")
    assert search.hybrid_search(docs, "balbula solenoide skf 6205").first().doc_id == 1
    assert search.hybrid_search(docs, vector=[0.0, 1.0]).first().doc_id == 2
    assert search.hybrid_search(docs, "pump", synonyms={"bomba": ["pump"]}).first().doc_id == 3
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]
    assert v.select(sign_agreement(F.col("a"), F.col("b"))).first()[0] == 1.0
    assert np.linalg.norm(embed("Bomba 12", 32)) == pytest.approx(1, abs=1e-6) and not embed("", 32).any()


def test_geo(spark):
    p = spark.createDataFrame([(1, 4.0, -74.0), (2, 4.001, -74.0), (3, 4.002, -74.0), (4, 10.0, 179.9999), (5, 10.0, -179.9999), (6, 89.9999, 10.0), (7, 89.9999, -170.0)], "id int, lat double, lon double")
    pairs = {(r.a, r.b) for r in geo.distance_join(p, p, 200).collect() if r.a < r.b}
    assert pairs == {(1, 2), (2, 3), (4, 5), (6, 7)}
    assert geo.geofence(p, "lat", "lon", (4.0, -74.0), 200).count() == 2
    clusters = {r.id: r.cluster for r in geo.dbscan(p, 200, 3).collect()}
    assert clusters[1] == clusters[2] == clusters[3] == 2 and clusters[4] is None


def brute_dbscan(rows, radius_m, least):
    """The sorted (id, cluster) of rows (id, lat, lon), each a point, by lists."""
    def near(p, q):
        if None in p or None in q:
            return False
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * geo.RADIUS_M * math.asin(math.sqrt(min(a, 1.0))) <= radius_m

    reach = [[j for j, q in enumerate(rows) if near(p, q)] for p in rows]
    core = {i for i, js in enumerate(reach) if len(js) >= least}
    label = {}
    for i in sorted(core, key=lambda i: rows[i][0]):
        todo = [] if i in label else [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = rows[i][0]
                todo += [j for j in reach[k] if j in core]
    return sorted((r[0], min((label[j] for j in js if j in core), default=-1)) for r, js in zip(rows, reach, strict=True))


def test_dbscan_of_long_chains_and_copies(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 284)
    rows = [(ids.pop(), 4 + k * 0.001, -74.0) for k in range(200) if k != 120]  # some 111 m apart, with one gap
    rows += [(ids.pop(), 6 + rng.randrange(20) / 1000, -74 + rng.randrange(20) / 1000) for _ in range(80)]
    rows += [(ids.pop(), 7.0, -75.0) for _ in range(5)]
    rng.shuffle(rows)
    for odd in ([], [(20_000, None, -74.0), (20_001, 4.0, None), (20_002, None, None), *rows[:40]]):  # unknown places are noise; every row is a point
        found = geo.dbscan(spark.createDataFrame(rows + odd, "id long, lat double, lon double"), 150, 3).collect()
        got = sorted((r.id, -1 if r.cluster is None else r.cluster) for r in found)
        assert got == brute_dbscan(rows + odd, 150, 3)
        assert len({c for _, c in got}) > 4 and -1 in {c for _, c in got}


def test_outbox(spark):
    now = dt.datetime(2024, 1, 1)
    box = spark.createDataFrame([(1, "PENDING", 0, None, None, now), (2, "FAILED", 2, now - dt.timedelta(1), None, now), (3, "FAILED", 5, None, None, now), (4, "PROCESSING", 0, None, now - dt.timedelta(1), now)], "event_id int, status string, retry_count int, retry_at timestamp, claimed_at timestamp, created_at timestamp")
    t = F.lit(now)
    assert [r.event_id for r in outbox.due(box, t).collect()] == [1, 2]
    claimed = outbox.claim(box, outbox.due(box, t), t)
    assert claimed.where("status = 'PROCESSING'").count() == 3
    done = {r.event_id: r for r in outbox.settle(claimed, spark.createDataFrame([(1, True), (2, False)], "event_id int, ok boolean"), t).collect()}
    assert done[1].status == "SENT" and done[2].status == "FAILED" and done[2].retry_count == 3 and done[2].retry_at == now + dt.timedelta(seconds=120)
    assert outbox.release_orphans(box, t).where("status = 'PENDING'").count() == 2


def test_synopses_merge(spark):
    df = spark.createDataFrame([(i % 7, float(i * i % 101)) for i in range(500)], "b int, x double")
    m, d = S.merge_synopses(S.synopsis(df, "x", ["b"])).first(), df.agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).first()
    assert m.mean == pytest.approx(d.m) and m.variance == pytest.approx(d.v) and m.n == 500
