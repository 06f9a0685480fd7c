"""CSV output that no spreadsheet runs as formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First characters that make a cell a formula.
RISKY = r"^[=+\-@\t\r]"
INLINE_ROWS = 5000


def safe_cells(df: DataFrame) -> DataFrame:
    """All columns as text: formula starts get a quote before them, whole numbers no fraction, null stays null."""
    return df.select(*(cell(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes))


def cell(c: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    if kind != "string":
        return c.cast("string")
    return F.when(c.rlike(RISKY), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and rows into a folder, in parallel."""
    safe_cells(df).write.option("header", True).option("quoteAll", False).option("escape", '"').mode("overwrite").csv(path)
