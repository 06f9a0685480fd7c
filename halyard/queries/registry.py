"""The registry that query modules fill."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans.planner import Engine
from halyard.plans.request import parse_request
from halyard.sources.tables import REGISTRY, loader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The clock of queries with a time frame: the events end just before.
NOW = dt.datetime(2024, 1, 31)


def query(sql: str | None = None, name: str | None = None, doubles: str = ""):
    """Registers a function of (spark, sf_dir) under its name.

    Sums of doubles depend on their order in the last digits, so both sides
    round: Spark all double columns, the SQL those named in ``doubles``.
    """
    def add(f):
        key = name or f.__name__
        if sql:
            cut = ", ".join(f"CASE WHEN abs({c}) >= 1e6 THEN round({c}, 2) WHEN abs({c}) >= 1 THEN round({c}, 5) ELSE round({c}, 9) END AS {c}" for c in doubles.split())
            ORACLES[key] = f"SELECT * REPLACE ({cut}) FROM ({sql})" if cut else sql
        QUERIES[key] = (lambda spark, sf_dir: rounded(f(spark, sf_dir))) if sql else f
        return f
    return add


def rounded(df: DataFrame) -> DataFrame:
    def cut(c: str):
        x = F.col(f"`{c}`").cast("double")
        return F.when(F.abs(x) >= 1e6, F.round(x, 2)).when(F.abs(x) >= 1, F.round(x, 5)).otherwise(F.round(x, 9)).alias(c)

    return df.select(*(cut(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, REGISTRY, loader(spark, sf_dir), NOW)


def _doubles(body: dict) -> str:
    """The double columns of a request's result."""
    r = parse_request(body)
    measures, model = {n for n, _ in r.measures}, REGISTRY.model(r.entity)
    if not r.metrics:
        names = list(r.select) if r.select else [a.name for a in model.attributes] + sorted(measures)
        return " ".join(n for n in names if n in measures or n not in measures and model[n].type == "double")
    out = [m.alias for m in r.metrics]
    for k, c in enumerate(r.comparisons):
        kind = c.type.upper()
        for m in r.metrics:
            out += [f"mean_{m.alias}", f"std_{m.alias}", f"z_score_{m.alias}"] if kind == "SMART" else [f"current_{m.alias}", f"prev_{k}_{m.alias}"] if kind != "BENCHMARK" else []
        out += [f"benchmark_{c.label or 'value'}"] if kind == "BENCHMARK" else []
    if any(c.type.upper() != "SMART" for c in r.comparisons):
        out.append("previous_value")
    return " ".join(dict.fromkeys(out))


def request(name: str, sql: str, **body) -> None:
    """Registers a request; the whole result counts, paged only where the request is about pages."""
    paged = "limit" in body or "cursor" in body

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = engine(spark, sf_dir).run(body)
        return got.rows if paged else got.whole

    query(sql, name, _doubles(body))(run)
