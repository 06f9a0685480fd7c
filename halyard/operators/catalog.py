"""Listings: distinct values of an attribute, ids by equality, and overlays of live values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPLORE_DEFAULT, EXPLORE_MOST = 100, 5000


def explore(df: DataFrame, attribute: str, limit: int = EXPLORE_DEFAULT) -> DataFrame:
    """Distinct values that are neither null nor empty, in order, at most ``limit`` (a report's length)."""
    c = F.col(f"`{attribute}`")
    return df.where(c.isNotNull() & (c.cast("string") != "")).select(c.alias("value")).distinct().orderBy("value").limit(min(limit, EXPLORE_MOST))


def list_ids(df: DataFrame, key: str, equal: dict[str, str], limit: int) -> tuple[DataFrame, bool]:
    """Ids of rows whose text columns equal the given ones, in order and cut, and whether any were cut."""
    for name, value in equal.items():
        df = df.where(F.col(f"`{name}`").cast("string") == F.lit(str(value)))
    ids = df.select(F.col(key).alias("id")).orderBy("id")
    return ids.limit(limit), bool(ids.offset(limit).limit(1).count())


def overlay(df: DataFrame, live: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Columns replaced by a live table's values where it has any."""
    fresh = live.select(F.col(key).alias("__key"), *(F.col(n).alias(f"__{n}") for n in names))
    joined = df.join(fresh, df[key] == F.col("__key"), "left")
    return joined.select(*(F.coalesce(f"__{c}", f"`{c}`").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


def same_rows(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Set operations by column name: union (distinct), union_all, intersect, except."""
    b = b.select(*a.columns)
    if how == "union_all":
        return a.unionByName(b)
    if how == "union":
        return a.unionByName(b).distinct()
    if how == "intersect":
        return a.intersect(b)
    if how == "except":
        return a.subtract(b)
    raise ValueError(f"unknown set operation {how!r}")


def row_bitmaps(df: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """(by, bucket, bits): bitmaps of row ids, to be combined by ``bitmap_or_agg``."""
    i = F.col(id_col).cast("long")
    return df.groupBy(*by, F.bitmap_bucket_number(i).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("bits"))


def bitmap_cardinality(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ids of merged bitmaps."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))
