"""Session settings that the engine relies on, and shipping the package to executors."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(app: str = "halyard", master: str | None = None, **confs: str) -> SparkSession:
    """A session with the engine's settings; ``confs`` come last. ANSI mode stays on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONFS, **confs}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    make_importable(spark)
    return spark


def make_importable(spark: SparkSession) -> None:
    """Python workers find this package where it lies; it has to be installed on (or shipped to) the cluster's machines."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(":")
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, have)])
