"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset (tests), a new temporary one, set for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="halyard-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows that a task writes at least, where a bound on a narrow table's rows is known.
TASK_ROWS = 1 << 16


def together(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows at most, in no more tasks than these need."""
    return df.coalesce(rows // TASK_ROWS + 1)


class Scratch:
    """Tables of one operator run, written to the shared folder and read back without their lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/halyard-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: no more than these, if known; a task then writes several partitions of a few rows as one file."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        # whoever reads it holds what this returns, so no _SUCCESS file is needed
        (df if rows is None else together(df, rows)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that ``keep`` returned and nothing later reads."""
        self._delete(self._paths.pop(id(df)))

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
