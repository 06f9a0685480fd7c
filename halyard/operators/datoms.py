"""Immutable facts: current state, as-of reads, history, deltas and writes.

A datom is (tenant_id, entity_type, entity_id, attr, value, tx_id, op); ``op``
true asserts, false retracts. The last one of an attribute counts; of an
assertion and a retraction in the same transaction the assertion does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATOM = "tenant_id string, entity_type string, entity_id string, attr string, value string, tx_id long, op boolean"
KEYS = ["tenant_id", "entity_type", "entity_id"]


def latest(datoms: DataFrame, as_of: int | None = None) -> DataFrame:
    """(keys, attr, value, tx_id) of attributes that are set, at a transaction or now; one partial aggregation, no window."""
    if as_of is not None:
        datoms = datoms.where(F.col("tx_id") <= as_of)
    last = F.max_by(F.struct("value", "op"), F.struct("tx_id", "op"))
    return datoms.groupBy(*KEYS, "attr").agg(last.alias("last"), F.max("tx_id").alias("tx_id")).where("last.op").select(*KEYS, "attr", F.col("last.value").alias("value"), "tx_id")


def wide(state: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """One row an entity with typed columns; text that doesn't fit its type is null. Attributes are known, so no pass looks for them."""
    values = [F.try_to_timestamp(F.max(F.when(F.col("attr") == a, F.col("value")))).alias(a) if t == "timestamp" else F.max(F.when(F.col("attr") == a, F.col("value"))).try_cast(t).alias(a) for a, t in attributes.items()]
    return state.groupBy(*KEYS).agg(*values)


def history(datoms: DataFrame, tx_log: DataFrame | None = None, entity_id: str | None = None, untracked: tuple[str, ...] = ()) -> DataFrame:
    """All datoms in order, with the actor of each transaction; attributes that keep no history are left out."""
    if entity_id is not None:
        datoms = datoms.where(F.col("entity_id") == entity_id)
    if untracked:
        datoms = datoms.where(~F.col("attr").isin(*untracked))
    if tx_log is not None:
        datoms = datoms.join(tx_log.select("tx_id", "user_id"), "tx_id", "left").select(*datoms.columns, "user_id")
    return datoms.orderBy("tx_id", "entity_id", "attr", "op")


def rows_to_values(rows: DataFrame, key: str, entity_type: str, tenant: str) -> DataFrame:
    """(keys, attr, value): one row for each attribute of each entity row."""
    names = [c for c in rows.columns if c != key]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").cast("string").alias("value")) for c in names)))
    return rows.select(F.lit(tenant).alias("tenant_id"), F.lit(entity_type).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), pairs.alias("p")).select(*KEYS, "p.attr", "p.value")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(keys, attr, before, after) of the attributes whose value changes; null on an absent attribute is no change."""
    b = before.select(*KEYS, "attr", F.col("value").alias("before"))
    a = after.select(*KEYS, "attr", F.col("value").alias("after"))
    return b.join(a, [*KEYS, "attr"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def plan_write(state: DataFrame, updates: DataFrame, tx_id: int) -> DataFrame:
    """Datoms of an upsert of given attributes: a retraction of the old value and an assertion of the new, only where they differ. A null takes the value away."""
    keyed = updates.select(*KEYS, "attr", F.col("value").alias("new"), F.lit(True).alias("given"))
    both = keyed.join(state.select(*KEYS, "attr", F.col("value").alias("old")), [*KEYS, "attr"], "left").where(~F.col("old").eqNullSafe(F.col("new")))
    out = F.array_compact(F.array(F.when(F.col("old").isNotNull(), F.struct(F.col("old").alias("value"), F.lit(False).alias("op"))), F.when(F.col("new").isNotNull(), F.struct(F.col("new").alias("value"), F.lit(True).alias("op")))))
    return both.select(*KEYS, "attr", F.explode(out).alias("d"), F.lit(tx_id).cast("long").alias("tx_id")).select(*KEYS, "attr", "d.value", "tx_id", "d.op")


def plan_delete(state: DataFrame, entities: DataFrame, tx_id: int) -> DataFrame:
    """Retractions of everything that the entities hold."""
    return state.join(entities.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, "attr", "value", F.lit(tx_id).cast("long").alias("tx_id"), F.lit(False).alias("op"))


def missing(entities: DataFrame, state: DataFrame) -> DataFrame:
    """Entities of an update or delete that don't exist; must be empty, as there is no upsert of unknown ones."""
    return entities.select(*KEYS).distinct().join(state.select(*KEYS).distinct(), KEYS, "left_anti")


def transact(datoms: DataFrame, *writes: DataFrame) -> DataFrame:
    """Several writes as one append."""
    for w in writes:
        datoms = datoms.unionByName(w)
    return datoms


def visible(rows: DataFrame, epoch: int) -> DataFrame:
    """Rows of a versioned table that exist at an epoch: asserted by then and not yet retracted."""
    return rows.where((F.col("assert_epoch") <= epoch) & (F.lit(epoch) < F.coalesce("retract_epoch", F.lit(2**63 - 1))))


def lookup_at(rows: DataFrame, attribute: str, value, epoch: int) -> DataFrame:
    return visible(rows, epoch).where(F.col(attribute) == F.lit(value))
