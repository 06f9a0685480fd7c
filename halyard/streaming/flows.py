"""Structured Streaming flows. Extensions: the batch operators define what they must give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pyramid_stream(events: DataFrame, subject: str, time: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling rollups with a watermark: (subject, bucket, n, sum, min, max)."""
    t = F.col(time).cast("timestamp")
    rows = events.withColumn("__t", t).withWatermark("__t", late)
    return rows.groupBy(subject, F.window("__t", width)).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")).select(subject, F.col("window.start").alias("bucket"), "n", "sum", "min", "max")


def ema_stream(events: DataFrame, key: str, time: str, value: str, alpha: float = 0.25) -> DataFrame:
    """(key, n, ema): an exponential mean kept per key. Order holds within a batch and from batch to batch."""
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(time)
        for x in rows[value]:
            mean = x if n == 0 else alpha * x + (1 - alpha) * mean
            n += 1
        state.update((n, mean))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [mean]})

    return events.select(key, time, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def debit_stream(events: DataFrame, key: str, amount: str, time: str, late: str = "1 hour") -> DataFrame:
    """Debits counted once an idempotency key, however often they are sent within the watermark."""
    return events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).select(key, amount, "__t")


def matched_stream(events: DataFrame, rules: DataFrame, on: str) -> DataFrame:
    """Events with the static rules that name their kind."""
    return events.join(rules, on)


def drain(folder_schema: T.StructType, spark, folder: str, send: Callable[[DataFrame, int], None], checkpoint: str):
    """An outbox folder read as a stream; ``send`` gets every micro-batch with its number, and a batch that fails is sent again."""
    rows = spark.readStream.schema(folder_schema).parquet(folder)
    return rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
