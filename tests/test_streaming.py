"""Streams give what the batch operators give."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from halyard.operators.timeseries import ema, pyramid
from halyard.streaming.flows import debit_stream, drain, ema_stream, pyramid_stream

SCHEMA = "k string, ts timestamp_ntz, x double"
ROWS = [("a" if i % 2 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), float(i % 5)) for i in range(40)]


def run(flow, mode, spark, name):
    q = flow.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    got = {(r.k, r.bucket.replace(tzinfo=None)): r.sum for r in run(pyramid_stream(stream(), "k", "ts", "x"), "complete", spark, "rollups").collect()}
    want = {(r.k, r.bucket): r.sum for r in pyramid(rows, "k", "ts", "x", "1h").collect()}
    assert got == want
    final = run(ema_stream(stream(), "k", "ts", "x"), "update", spark, "means").groupBy("k").agg(F.max_by("ema", "n").alias("ema")).collect()
    batch = {r.k: r.ema_fast for r in ema(rows, ["k"], ["ts"], "x").collect()}
    assert {r.k: round(r.ema, 9) for r in final} == {k: round(v, 9) for k, v in batch.items()}
    assert run(debit_stream(stream(), "k", "x", "ts"), "append", spark, "debits").count() == 2
    sent = []
    drain(rows.schema, spark, path, lambda df, n: sent.append(df.count()), str(tmp_path / "check")).awaitTermination(120)
    assert sum(sent) == 40
