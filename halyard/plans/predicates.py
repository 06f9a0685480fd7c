"""Filter trees as Column expressions.

What a missing value gives is fixed per operator (SQL would give null):
comparisons, BETWEEN, LIKE and CONTAINS are false, NEQ and NOT_IN are true.
They say so as ``is not null and ...``, which the Parquet scan can take.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions.text import fold, fuzzy_match
from halyard.plans.model import column, resolve


class FilterError(ValueError):
    pass


#: Values above this count milliseconds, others seconds.
MS_FROM = 10**11
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def time_literal(value: Any, kind: T.DataType) -> Column:
    """A timestamp column's literal from epoch seconds or milliseconds, ISO text or datetime (UTC)."""
    if isinstance(value, bool):
        raise FilterError(f"{value!r} is no point in time")
    if isinstance(value, (int, float)):
        value = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=value / 1000 if abs(value) > MS_FROM else value)
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime) and value.tzinfo:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    text = F.lit(value.isoformat(sep=" "))
    return text.cast("date") if isinstance(kind, T.DateType) else F.to_timestamp_ntz(text) if isinstance(kind, T.TimestampNTZType) else text.cast("timestamp")


def same_kind(kind: T.DataType, value: Any) -> Column | None:
    """The literal if it can equal a value of this type at all."""
    if isinstance(kind, TIMES):
        return time_literal(value, kind) if not isinstance(value, bool) else None
    if isinstance(kind, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if isinstance(kind, NUMERIC):
        return F.lit(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(kind, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    return None


def _eq(c, kind, v):
    x = same_kind(kind, v)
    return F.lit(False) if x is None else known(c, c == x)


def known(c: Column, condition: Column) -> Column:
    """The condition, false where the column is missing."""
    return c.isNotNull() & condition


def _neq(c, kind, v):
    x = same_kind(kind, v)
    return F.lit(True) if x is None else c.isNull() | (c != x)


def _ordered(op: Callable[[Column, Column], Column]):
    def build(c, kind, v):
        if isinstance(kind, TIMES):
            return known(c, op(c, time_literal(v, kind)))
        if isinstance(kind, NUMERIC) and isinstance(v, (int, float)) and not isinstance(v, bool):
            return known(c, op(c, F.lit(v)))
        return F.lit(False)
    return build


def _strings(v) -> list[str]:
    return [x.strip() for x in v.split(",")] if isinstance(v, str) else [str(x) for x in v or ()]


def _as_text(c, kind):
    return c if isinstance(kind, T.StringType) else F.lit(None).cast("string")


def _in(c, kind, v):
    if isinstance(kind, NUMERIC) and isinstance(v, (list, tuple)) and all(isinstance(x, (int, float)) for x in v):
        return known(c, c.isin(list(v)))
    c, wanted = _as_text(c, kind), _strings(v)
    return known(c, c.isin(wanted)) if "" not in wanted else c.isNull() | c.isin(wanted)


def _not_in(c, kind, v):
    if v is None or v == []:
        return F.lit(True)
    return ~_in(c, kind, v)


def _between(c, kind, v):
    lo, hi = v
    if isinstance(kind, TIMES):
        return known(c, c.between(time_literal(lo, kind), time_literal(hi, kind)))
    if isinstance(kind, NUMERIC) and not isinstance(lo, str):
        return known(c, c.between(F.lit(lo), F.lit(hi)))
    if isinstance(kind, T.StringType):
        return known(c, c.between(F.lit(str(lo)), F.lit(str(hi))))
    return F.lit(False)


def _like(c, kind, v):
    return F.coalesce(fold(_as_text(c, kind)), F.lit("")).like(fold_text(v))


def fold_text(s: str) -> str:
    return s.lower().translate(str.maketrans("áéíóúüñ", "aeiouun"))


def _contains(c, kind, v):
    if not v:
        return F.lit(False)
    p = F.lit(fold_text(v))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: F.coalesce(F.contains(fold(x), p), F.lit(False))), F.lit(False))
    return F.coalesce(F.contains(fold(_as_text(c, kind)), p), F.lit(False))


OPERATORS: dict[str, Callable[[Column, T.DataType, Any], Column]] = {
    "EQ": _eq, "NEQ": _neq,
    "GT": _ordered(lambda a, b: a > b), "GTE": _ordered(lambda a, b: a >= b), "LT": _ordered(lambda a, b: a < b), "LTE": _ordered(lambda a, b: a <= b),
    "IN": _in, "NOT_IN": _not_in, "BETWEEN": _between, "LIKE": _like, "CONTAINS": _contains,
    "MATCHES": lambda c, k, v: fuzzy_match(_as_text(c, k), v),
    "FUZZY": lambda c, k, v: fuzzy_match(_as_text(c, k), v),
    "IS_NULL": lambda c, k, v: c.isNull(), "IS_NOT_NULL": lambda c, k, v: c.isNotNull(),
}
#: Operators of the list form ``["=", column, value]``.
LIST_OPERATORS = {"=": "EQ", "!=": "NEQ", ">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE", "in": "IN", "not-in": "NOT_IN", "between": "BETWEEN", "matches": "MATCHES", "like": "LIKE", "contains": "CONTAINS", "is-null": "IS_NULL", "is-not-null": "IS_NOT_NULL", "fuzzy": "FUZZY"}


def normalise(node: Any) -> dict:
    """The list form of a node as a dict."""
    if isinstance(node, dict):
        return node
    if node in ([], None):
        return {"conjunction": "AND", "nodes": []}
    head, *rest = node
    if head.lower() in ("and", "or", "not"):
        return {"conjunction": head.upper(), "nodes": [normalise(n) for n in rest]}
    if head.lower() not in LIST_OPERATORS:
        raise FilterError(f"unknown operator {head!r}")
    op = LIST_OPERATORS[head.lower()]
    return {"field": rest[0], "op": op, "value": rest[1:] if op == "BETWEEN" and len(rest) == 3 else rest[1] if len(rest) > 1 else None}


def compile_filter(df: DataFrame, node: Any) -> Column:
    """A condition over the columns of ``df``; a group without members is true, NOT negates the conjunction of its members."""
    node = normalise(node)
    if "conjunction" in node:
        parts = [compile_filter(df, n) for n in node.get("nodes", ())]
        kind = node["conjunction"].upper()
        if kind not in ("AND", "OR", "NOT"):
            raise FilterError(f"unknown conjunction {kind!r}")
        if not parts:
            return F.lit(True)
        if kind == "OR":
            return reduce(lambda a, b: a | b, parts)
        both = reduce(lambda a, b: a & b, parts)
        return ~both if kind == "NOT" else both
    op = str(node.get("op", "")).upper()
    if op not in OPERATORS:
        raise FilterError(f"unknown operator {op!r}")
    name = resolve(df, node["field"])
    return OPERATORS[op](column(df, name), df.schema[name].dataType, node.get("value"))


def fields_of(node: Any) -> list[str]:
    node = normalise(node)
    return [f for n in node["nodes"] for f in fields_of(n)] if "conjunction" in node else [node["field"]]
