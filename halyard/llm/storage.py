"""Bounds on what is taken from tables at once; the tables in the shared folder are halyard.storage's."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.storage import Scratch  # noqa: F401

#: Rows that Arrow hands to Python at once, at most; with texts of a few kilobytes these are a few megabytes.
BATCH_ROWS = 2048
#: Bytes of batches after which a worker gives back what it has freed.
FREED_AFTER = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS where they are larger, as texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Returns memory that is free, but kept by Arrow's and C's allocators, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def sparing(f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, giving back memory after some batches and at the end: workers are kept for later tasks, idle beside a JVM that then needs the room."""
    def run(batches):
        def handed():
            size = 0
            for b in batches:
                size += b.nbytes
                yield b
                del b
                if size >= FREED_AFTER:
                    give_back()
                    size = 0
        try:
            yield from f(handed())
        finally:
            give_back()
    return run


def highest(df: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """About ``n`` rows with the greatest ``size``, a whole number above 0; fewer rows are all of them.

    A histogram of sizes gives the least size to take, and a hash of ``key``
    the share of the rows of that size, so no task sees more than its own rows.
    """
    step = F.floor(F.when(F.col(size) < 64, F.col(size)).otherwise(64 * (F.log2(F.col(size) / 64) + 1))).cast("long")
    left, least, share = n, 0, 1.0
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # 64 steps to a doubling at most
        if r["count"] > left:
            least, share = r.step, left / r["count"]
            break
        left -= r["count"]
    part = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < math.floor(share * (1 << 20))
    return df.where((step > least) | (step == least) & part)
