"""Write-side checks: every row gets its violations, codes in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.plans.model import EntityModel


def _fits(text: Column, kind: str) -> Column:
    """Whether JSON-like text can be stored as a type; whole numbers may have a fraction that is cut."""
    if kind in ("number", "integer", "int", "long", "decimal", "double", "float"):
        return text.try_cast("double").isNotNull()
    if kind == "epoch":
        return text.try_cast("bigint").isNotNull()
    if kind == "boolean":
        return F.lower(text).isin("true", "false")
    return F.lit(True)


def coerce(text: Column, kind: str) -> Column:
    """Text as the type's value: truncated whole numbers, epoch milliseconds as timestamps; what doesn't fit is null."""
    if kind in ("number", "integer", "int", "long"):
        return text.try_cast("double").try_cast("bigint")
    if kind in ("decimal", "double", "float"):
        return text.try_cast("double")
    if kind == "epoch":
        return F.timestamp_millis(text.try_cast("bigint"))
    if kind == "boolean":
        return F.lower(text).try_cast("boolean")
    return text


def attribute_violations(df: DataFrame, model: EntityModel) -> DataFrame:
    """``violations``: ``attribute:reason`` of each attribute that is missing, of a wrong type, no option, or against its pattern."""
    found = []
    for a in model.attributes:
        if a.name not in df.columns:
            if a.required:
                found.append(F.lit(f"{a.name}:required"))
            continue
        c = F.col(f"`{a.name}`").cast("string")
        checks = F.when(c.isNull(), F.lit(f"{a.name}:required") if a.required else F.lit(None).cast("string")).when(~_fits(c, a.type), F.lit(f"{a.name}:type"))
        if a.type == "enum" and a.options and not a.open:
            checks = checks.when(~c.isin(*a.options), F.lit(f"{a.name}:option"))
        if a.pattern:
            checks = checks.when(~c.rlike(a.pattern), F.lit(f"{a.name}:pattern"))
        found.append(checks)
    return df.withColumn("violations", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def state_violations(df: DataFrame, constraints: list[dict]) -> DataFrame:
    """``violations`` by rules over the merged state.

    requires_when {field, when, equals}; at_most / at_least {field, value}; requires_any {fields}.
    """
    found = []
    for r in constraints:
        kind, name = r["type"], r.get("field")
        if kind == "requires_when":
            bad = (F.col(r["when"]).cast("string") == str(r["equals"])) & F.col(name).isNull()
        elif kind in ("at_most", "at_least"):
            bad = F.col(name) > r["value"] if kind == "at_most" else F.col(name) < r["value"]
        elif kind == "requires_any":
            bad = F.coalesce(*(F.col(f).cast("string") for f in r["fields"])).isNull()
            name = "|".join(r["fields"])
        else:
            raise ValueError(f"unknown constraint {kind!r}")
        found.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name}:{kind}")))
    return df.withColumn("violations", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def reference_violations(df: DataFrame, field: str, target: DataFrame, key: str, state: str, allowed: list[str]) -> DataFrame:
    """Rows whose reference is to nothing or to an entity in a state that isn't allowed."""
    t = target.select(F.col(key).alias("__key"), F.col(state).alias("__state"))
    return df.where(F.col(field).isNotNull()).join(t, F.col(field) == F.col("__key"), "left").where(~F.coalesce(F.col("__state").isin(*allowed), F.lit(False))).drop("__key", "__state")


def unique_violations(new: DataFrame, existing: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(fields, ids): keys that several rows of ``new``, or a new and another existing row, claim; a key with a missing part isn't claimed."""
    full = " and ".join(f"`{f}` is not null" for f in fields)
    claims = new.select(*fields, F.col(key).alias("id"), F.lit(True).alias("new")).unionByName(existing.select(*fields, F.col(key).alias("id"), F.lit(False).alias("new"))).where(full)
    return claims.groupBy(*fields).agg(F.count_distinct("id").alias("n"), F.max("new").alias("new")).where("n > 1 and new").select(*fields, "n")
