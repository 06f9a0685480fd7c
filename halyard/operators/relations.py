"""References between entities: nested selects, semi-joins, children."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Table = Callable[[str], DataFrame]


def _reference(model, name: str):
    a = model[name]
    if not a.ref:
        raise ValueError(f"{model.name}.{name} is no reference")
    return a


def semi_join_filter(df: DataFrame, model, registry, table: Table, node: dict) -> DataFrame:
    """``reference.attribute op value``: rows whose referenced entity passes; two steps at most, as a left semi-join."""
    from halyard.plans.predicates import compile_filter

    parts = node["field"].split(".")
    if len(parts) != 2:
        raise ValueError(f"a path has two parts: {node['field']!r}")
    ref = _reference(model, parts[0])
    target, key = table(ref.ref), registry.model(ref.ref).key
    ids = target.where(compile_filter(target, {**node, "field": parts[1]})).select(F.col(key).alias("__ref"))
    if isinstance(df.schema[ref.name].dataType, T.ArrayType):
        # any element may pass: explode to (row key, element), semi-join, and back by key
        keys = df.select(F.col(model.key).alias("__key"), F.explode(ref.name).alias("__element")).join(ids, F.col("__element") == F.col("__ref"), "left_semi").select("__key").distinct()
        return df.join(keys, df[model.key] == F.col("__key"), "left_semi")
    return df.join(ids, df[ref.name] == F.col("__ref"), "left_semi")


def parse_select(tree: Any) -> dict:
    """A select tree as {name: subtree or None}; lists of names and nested dicts are both read."""
    if isinstance(tree, dict):
        return {k: parse_select(v) if v not in (None, True) else None for k, v in tree.items()}
    out: dict = {}
    for x in tree:
        out.update(parse_select(x) if isinstance(x, dict) else {x: None})
    return out


def nest(df: DataFrame, model, registry, table: Table, tree: dict) -> DataFrame:
    """The selected columns, references with a subtree as structs of the referenced row.

    A reference to nothing keeps a struct with its id alone; a list of references becomes a list of structs in its order.
    """
    out = df
    columns = []
    for name, sub in tree.items():
        if sub is None:
            columns.append(name)
            continue
        ref = _reference(model, name)
        target_model = registry.model(ref.ref)
        key = target_model.key
        target = nest(table(ref.ref), target_model, registry, table, {key: None, **{k: v for k, v in sub.items() if k != key}})
        packed = target.select(F.col(key).alias(f"__{name}_id"), F.struct(*target.columns).alias(f"__{name}"))
        kind = packed.schema[f"__{name}"].dataType
        missing = lambda c, kind=kind, key=key: F.struct(*(c.cast(f.dataType).alias(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))
        if isinstance(df.schema[name].dataType, T.ArrayType):
            each = out.select(F.col(model.key).alias("__key"), F.posexplode(name).alias("__at", "__element")).join(packed, F.col("__element") == F.col(f"__{name}_id"), "left")
            lists = each.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce(F.col(f"__{name}"), missing(F.col("__element"))).alias("v")))), lambda x: x.v).alias(f"__{name}"))
            out = out.join(lists, out[model.key] == F.col("__key"), "left").drop("__key")
            columns.append((name, F.coalesce(F.col(f"__{name}"), F.array().cast(T.ArrayType(kind)))))
        else:
            out = out.join(packed, out[name] == F.col(f"__{name}_id"), "left")
            columns.append((name, F.when(F.col(name).isNotNull(), F.coalesce(F.col(f"__{name}"), missing(F.col(name))))))
    return out.select(*(F.col(f"`{c}`") if isinstance(c, str) else c[1].alias(c[0]) for c in columns))


def with_has_children(df: DataFrame, all_rows: DataFrame, key: str, parent: str) -> DataFrame:
    """``has_children``: whether a row of the same entity names this one as its parent."""
    parents = all_rows.select(F.col(parent).alias("__parent")).where("__parent is not null").distinct()
    return df.join(parents, df[key] == F.col("__parent"), "left").withColumn("has_children", F.col("__parent").isNotNull()).drop("__parent")


def references_to(df: DataFrame, reference: str, target_id: Any) -> DataFrame:
    """Rows that refer to an entity."""
    if isinstance(df.schema[reference].dataType, T.ArrayType):
        return df.where(F.array_contains(reference, F.lit(target_id)))
    return df.where(F.col(reference) == F.lit(target_id))


def route(rules: DataFrame, hooks: DataFrame) -> DataFrame:
    """(rule_id, hook_id): active hooks by the rules they subscribe to, from an equi-join on exploded ids."""
    wanted = hooks.where("active").select("hook_id", F.explode("subscribed_rule_ids").alias("rule_id")).distinct()
    return rules.join(wanted, "rule_id").select("rule_id", "hook_id")
