"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches


def held_out(id_col: str = "doc_id", fold: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == rest, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, use=None) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled documents a class, those with the lowest hash of their id.

    Where rows of one id disagree, the larger label counts; null ids and labels are left out.
    ``use`` is a condition on doc_id for rows that may be learnt from.
    """
    bounded_batches(docs.sparkSession)
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if use is not None:
        ids = ids.where(use)
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    # ids only, from the labelled rows; each class is cut to its bound before any text is read
    parts = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
