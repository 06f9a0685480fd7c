"""The outbox's states as table expressions: what is due, claims, retries, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RETRIES = 5
FIRST_WAIT_S, MOST_WAIT_S = 30, 1800


def due(outbox: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Pending events, and failed ones with retries left whose time has come; oldest first."""
    failed = (F.col("status") == "FAILED") & (F.coalesce("retry_count", F.lit(0)) < MOST_RETRIES) & (F.coalesce(F.col("retry_at"), now) <= now)
    out = outbox.where((F.col("status") == "PENDING") | failed).orderBy("created_at", "event_id")
    return out.limit(limit) if limit else out


def wait_seconds(retries: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), retries) * FIRST_WAIT_S, F.lit(float(MOST_WAIT_S)))


def claim(outbox: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The outbox with the given events in processing."""
    taken = ids.select(F.col("event_id").alias("__id")).distinct()
    joined = outbox.join(taken, F.col("event_id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    return joined.withColumn("status", F.when(hit, "PROCESSING").otherwise(F.col("status"))).withColumn("claimed_at", F.when(hit, now).otherwise(F.col("claimed_at"))).drop("__id")


def settle(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Results (event_id, ok): sent, or failed with the next time to try."""
    r = results.select(F.col("event_id").alias("__id"), "ok")
    j = outbox.join(r, F.col("event_id") == F.col("__id"), "left")
    tries = F.coalesce("retry_count", F.lit(0)) + F.when(~F.col("ok"), 1).otherwise(0)
    j = j.withColumn("retry_at", F.when(~F.col("ok"), now + F.make_dt_interval(secs=wait_seconds(F.coalesce("retry_count", F.lit(0))))).otherwise(F.col("retry_at"))).withColumn("retry_count", tries)
    return j.withColumn("status", F.when(F.col("ok"), "SENT").when(~F.col("ok"), "FAILED").otherwise(F.col("status"))).drop("__id", "ok")


def release_orphans(outbox: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Events claimed too long ago are pending again."""
    old = (F.col("status") == "PROCESSING") & (F.unix_seconds(now) - F.unix_seconds(F.col("claimed_at")) > seconds)
    return outbox.withColumn("status", F.when(old, "PENDING").otherwise(F.col("status")))
