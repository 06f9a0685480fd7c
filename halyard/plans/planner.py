"""The planner: a request becomes one lazy DataFrame that Catalyst optimises.

Security comes first and cannot be left out by a request; then filters, time
window, measures, grouping, order and page. Periods that a KPI is compared with are
conditional aggregates of the same scan.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions.text import fuzzy_match, label
from halyard.operators.relations import nest, parse_select, semi_join_filter, with_has_children
from halyard.plans.formula import compile_formula
from halyard.plans.metrics import metric_column
from halyard.plans.model import EntityModel, Registry, column, resolve
from halyard.plans.predicates import NUMERIC, TIMES, compile_filter, fields_of, known, normalise, same_kind
from halyard.plans.request import Dimension, Metric, Page, Request, Security, check_request, parse_request
from halyard.plans.timeframe import Range, compare_range

Loader = Callable[[str], DataFrame]


@dataclass
class Result:
    """``rows`` is the page; ``whole`` is before paging."""

    rows: DataFrame
    whole: DataFrame
    offset: int
    limit: int

    def page(self) -> Page:
        return Page(self.whole.count(), self.offset, self.limit)


class Engine:
    """Answers requests over tables that ``load`` gives by entity name."""

    def __init__(self, spark: SparkSession, registry: Registry, load: Loader, now: dt.datetime | None = None):
        self.spark, self.registry, self.load = spark, registry, load
        self.now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        #: Hooks that replace or add columns before anything else reads a row.
        self.overlays: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._cache: dict[str, DataFrame] = {}

    def table(self, entity: str, security: Security = Security()) -> DataFrame:
        """The rows of an entity that the caller may see, without sensitive columns."""
        model = self.registry.model(entity)
        df = self.load(model.table or entity)
        if entity in self.overlays:
            df = self.overlays[entity](df)
        df = df.where(row_security(df, model, security))
        return df if security.reveal else df.drop(*model.sensitive())

    def run(self, request: Request | dict, security: Security = Security()) -> Result:
        r = parse_request(request) if isinstance(request, dict) else request
        check_request(r)
        model = self.registry.model(r.entity)
        df = self.table(r.entity, security)
        if r.entity_id is not None:
            df = df.where(column(df, model.key) == F.lit(r.entity_id))
        df = self._filtered(df, r, model, security)
        df, r = self._labelled(df, r, model, security)
        current = r.time_frame.resolve(self.now)
        if r.output == "KPI":
            whole = self._kpi(self._measured(df, r), r, model, current)
        else:
            if current and model.time:
                df = df.where(_within(df, model.time, current))
            df = self._measured(df, r)
            whole = self._grouped(df, r, model, current) if r.dimensions and (r.metrics or r.output in ("PIE", "BUBBLE", "TIMESERIES")) else self._overall(df, r) if r.metrics else self._rows(df, r, model, security)
        offset, limit = r.page()
        page = whole.offset(offset) if offset else whole
        return Result(page.limit(limit), whole, offset, limit)

    def run_batch(self, requests: dict[str, Request | dict], security: Security = Security(), threads: int = 4) -> dict[str, list]:
        """Rows of several requests, their Spark jobs side by side."""
        results = {k: self.run(r, security) for k, r in requests.items()}
        with ThreadPoolExecutor(threads) as pool:
            return dict(zip(results, pool.map(lambda x: x.rows.collect(), results.values()), strict=True))

    def cached(self, request: Request | dict, security: Security = Security()) -> DataFrame:
        """The page of a request, kept in Spark's cache under its canonical form, its caller and the resolved time window."""
        r = parse_request(request) if isinstance(request, dict) else request
        key = json.dumps([asdict(r), asdict(security), r.time_frame.resolve(self.now), self.load(self.registry.model(r.entity).table or r.entity).schema.json()], sort_keys=True, default=str)
        if key not in self._cache:
            self._cache[key] = self.run(r, security).rows.cache()
        return self._cache[key]

    def forget(self) -> None:
        """Drops what ``cached`` keeps, as after a write."""
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()

    def explain(self, request: Request | dict, security: Security = Security()) -> str:
        return self.run(request, security).rows._jdf.queryExecution().toString()

    # parts of a plan

    def _filtered(self, df: DataFrame, r: Request, model: EntityModel, security: Security) -> DataFrame:
        plain = []
        for node in map(normalise, r.filters):
            paths = [f for f in fields_of(node) if "." in f]
            if not paths:
                plain.append(node)
            elif "conjunction" in node:
                df = self._tree_with_paths(df, node, model, security)
            else:
                df = semi_join_filter(df, model, self.registry, lambda e: self.table(e, security), node)
        if plain:
            df = df.where(reduce(lambda a, b: a & b, (compile_filter(df, n) for n in plain)))
        if r.search:
            names = [a.name for a in model.attributes if a.fts and a.name in df.columns] or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
            df = df.where(fuzzy_match(F.concat_ws(" ", *(F.col(f"`{n}`") for n in names)), r.search))
        if r.hierarchy and not r.search and r.hierarchy.get("parent_field"):
            parent, node = column(df, r.hierarchy["parent_field"]), r.hierarchy.get("current_node_id")
            kind = df.schema[resolve(df, r.hierarchy["parent_field"])].dataType
            roots = parent.isNull() | (parent.cast("string").isin("", "null"))
            df = df.where(roots if node in (None, "", "__none__") else parent == F.lit(node).cast(kind))
        if r.hierarchy and r.hierarchy.get("inject_has_children"):
            df = with_has_children(df, self.table(r.entity, security), model.key, resolve(df, r.hierarchy["parent_field"]))
        return df

    def _tree_with_paths(self, df: DataFrame, node: dict, model: EntityModel, security: Security) -> DataFrame:
        """Dot paths within AND groups are semi-joins; elsewhere they have no meaning."""
        if node["conjunction"].upper() != "AND":
            raise ValueError("a path through a reference can only stand among conditions that all hold")
        for child in map(normalise, node["nodes"]):
            if any("." in f for f in fields_of(child)):
                df = self._tree_with_paths(df, child, model, security) if "conjunction" in child else semi_join_filter(df, model, self.registry, lambda e: self.table(e, security), child)
            else:
                df = df.where(compile_filter(df, child))
        return df

    def _labelled(self, df: DataFrame, r: Request, model: EntityModel, security: Security) -> tuple[DataFrame, Request]:
        """Label templates that name attributes of a reference join them; the template then names the joined columns."""
        dims = []
        for d in r.dimensions:
            text = d.label_template or ""
            for path in sorted(set(re.findall(r"\{\{\s*(\w+\.\w+)\s*\}\}", text))):
                name, attribute = path.split(".")
                if name not in df.columns or not any(a.name == name and a.ref for a in model.attributes):
                    continue
                target_model = self.registry.model(model[name].ref)
                joined = f"{name}__{attribute}"
                if joined not in df.columns:
                    target = self.table(model[name].ref, security)
                    near = target.select(F.col(target_model.key).alias("__ref"), column(target, attribute).alias(joined))
                    df = df.join(near, df[name] == F.col("__ref"), "left").drop("__ref")
                text = re.sub(r"\{\{\s*" + re.escape(path) + r"\s*\}\}", "{{" + joined + "}}", text)
            dims.append(replace(d, label_template=text or None))
        return df, replace(r, dimensions=tuple(dims))

    @staticmethod
    def _measured(df: DataFrame, r: Request) -> DataFrame:
        """Measures are columns of rows, so metrics can aggregate them."""
        for name, text in r.measures:
            df = df.withColumn(name, compile_formula(text, lambda v, df=df: _number(df, v)))
        return df

    def _values(self, df: DataFrame, metrics: tuple[Metric, ...], windows: dict[str, Column | None]) -> tuple[DataFrame, dict[tuple[int, str], Column]]:
        """Columns that the metrics aggregate, for each window, and the aggregates."""
        extra, aggregates = {}, {}
        for i, m in enumerate(metrics):
            numeric = m.attribute and _is_number(df, m.attribute)
            value = _number(df, m.attribute) if numeric else column(df, m.attribute) if m.attribute and m.aggregation.upper() == "COUNT_DISTINCT" else None
            second = _number(df, m.secondary) if m.secondary else None
            own = compile_filter(df, m.filter) if m.filter else None
            for w, inside in windows.items():
                mask = own if inside is None else inside if own is None else own & inside
                cut = (lambda c, mask=mask: F.when(mask, c)) if mask is not None else lambda c: c
                names = []
                for part, c in (("v", value), ("s", second), ("r", F.lit(1) if mask is not None else None)):
                    names.append(f"__{part}{i}{w}" if c is not None else None)
                    if c is not None:
                        extra[names[-1]] = cut(c)
                aggregates[i, w] = metric_column(m.aggregation, *names)
        return df.withColumns(extra) if extra else df, aggregates

    def _overall(self, df: DataFrame, r: Request) -> DataFrame:
        df, aggregates = self._values(df, r.metrics, {"": None})
        return df.agg(*(c.alias(r.metrics[i].alias) for (i, _), c in aggregates.items()))

    def _grouped(self, df: DataFrame, r: Request, model: EntityModel, current: Range | None) -> DataFrame:
        keys = [self._key(df, d, model, r).alias(d.alias) for d in r.dimensions]
        metrics = r.metrics or (Metric(name="count"),)
        df, aggregates = self._values(df, metrics, {"": None})
        names = [d.alias for d in r.dimensions]
        carried = [c for c in df.columns if c.startswith("__")]
        df = df.select(*keys, *carried)
        if r.output in ("PIE", "BUBBLE"):
            texts = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
            df = df.where(F.coalesce(*texts).isNotNull())
        out = df.groupBy(*(F.col(f"`{n}`") for n in names)).agg(*(c.alias(metrics[i].alias) for (i, _), c in aggregates.items()))
        times = [d for d in r.dimensions if d.interval]
        if r.fill_gaps and times:
            out = fill_gaps(out, times[0], [n for n in names if n != times[0].alias], metrics, current)
        return self._ordered(out, r, names, metrics)

    def _key(self, df: DataFrame, d: Dimension, model: EntityModel, r: Request) -> Column:
        name = resolve(df, d.attribute)
        if d.interval:
            return bucket(F.col(f"`{name}`"), d.interval.lower(), r.time_frame.timezone, df.schema[name].dataType)
        if d.label_template:
            return label(d.label_template, df.columns, dict(df.dtypes))
        return F.col(f"`{name}`")

    def _ordered(self, out: DataFrame, r: Request, names: list[str], metrics: tuple[Metric, ...]) -> DataFrame:
        order = [(F.desc_nulls_last if down else F.asc_nulls_last)(f"`{resolve(out, f)}`") for f, down in r.sort]
        if not r.sort and r.output in ("PIE", "BUBBLE"):
            order = [F.desc_nulls_last(f"`{metrics[0].alias}`")]
        return out.orderBy(*order, *(F.asc_nulls_last(f"`{n}`") for n in names))

    def _rows(self, df: DataFrame, r: Request, model: EntityModel, security: Security) -> DataFrame:
        if r.select:
            df = nest(df, model, self.registry, lambda e: self.table(e, security), parse_select(r.select))
        keys = [model.key] if model.key in df.columns else []
        order = [(F.desc_nulls_last if down else F.asc_nulls_last)(f"`{resolve(df, f)}`") for f, down in r.sort]
        return df.orderBy(*order, *(F.asc_nulls_last(f"`{k}`") for k in keys)) if order or keys else df

    def _kpi(self, df: DataFrame, r: Request, model: EntityModel, current: Range | None) -> DataFrame:
        windows: dict[str, Column | None] = {"": _within(df, model.time, current) if current and model.time else None}
        ranges: dict[int, Range] = {}
        for k, c in enumerate(r.comparisons):
            if c.type.upper() != "BENCHMARK" and current and model.time:
                ranges[k] = compare_range(c.type, current, c.granularity, c.amount, c.shortcut, c.start_ms, c.end_ms)
                windows[f"_{k}"] = _within(df, model.time, ranges[k])
        if current and model.time:  # one scan of no more than all periods
            df = df.where(reduce(lambda a, b: a | b, [w for w in windows.values() if w is not None]))
        df, aggregates = self._values(df, r.metrics, windows)
        out: dict[str, Column] = {}
        for i, m in enumerate(r.metrics):
            out[m.alias] = aggregates[i, ""]
        for k, c in enumerate(r.comparisons):
            if c.type.upper() == "BENCHMARK":
                out[f"benchmark_{c.label or 'value'}"] = F.max(F.lit(float(c.value)))
            for i, m in enumerate(r.metrics) if k in ranges else ():
                if c.type.upper() == "SMART":
                    if f"__v{i}_{k}" in df.columns:
                        mean, std = F.coalesce(F.avg(f"__v{i}_{k}"), F.lit(0.0)), F.coalesce(F.stddev_samp(f"__v{i}_{k}"), F.lit(0.0))
                        out[f"mean_{m.alias}"], out[f"std_{m.alias}"] = mean, std
                        out[f"z_score_{m.alias}"] = F.coalesce(F.try_divide(aggregates[i, ""] - mean, std), F.lit(0.0))
                else:
                    out[f"current_{m.alias}"] = aggregates[i, ""]
                    out[f"prev_{k}_{m.alias}"] = aggregates[i, f"_{k}"]
        got = df.agg(*(c.alias(n) for n, c in out.items()))
        before = next((n for n in out if n.startswith("prev_")), None) or ("benchmark_value" if "benchmark_value" in out else next((n for n in out if n.startswith("benchmark_")), None))
        return got.withColumn("previous_value", F.col(before)) if before else got


def row_security(df: DataFrame, model: EntityModel, s: Security) -> Column:
    """Tenant, scope and permitted places as one condition; a scope that needs a column the entity lacks sees nothing."""
    out = F.lit(True)
    if model.tenant:
        if s.tenant is None:
            raise PermissionError(f"{model.name} needs a tenant")
        out = known(F.col(f"`{model.tenant}`"), F.col(f"`{model.tenant}`") == F.lit(s.tenant))
    scopes = {x.upper() for x in s.scopes}
    own = known(F.col(f"`{model.owner}`"), F.col(f"`{model.owner}`") == F.lit(s.user)) if model.owner else F.lit(False)
    if model.assignees and isinstance(df.schema[model.assignees].dataType, T.ArrayType):
        assigned = F.coalesce(F.array_contains(model.assignees, F.lit(s.user)), F.lit(False))
    else:
        assigned = known(F.col(f"`{model.assignees}`"), F.col(f"`{model.assignees}`") == F.lit(s.user)) if model.assignees else F.lit(False)
    if "ALL" not in scopes:
        seen = {"OWN": own, "ASSIGNED": assigned, "OWN_OR_ASSIGNED": own | assigned}
        out = out & reduce(lambda a, b: a | b, [seen[x] for x in sorted(scopes) if x in seen], F.lit(False))
    if s.locations and model.location:
        out = out & known(F.col(f"`{model.location}`"), F.col(f"`{model.location}`").isin(list(s.locations)))
    return out


def _within(df: DataFrame, time: str, r: Range) -> Column:
    """Inclusive at both ends; a row without a time lies nowhere."""
    kind = df.schema[resolve(df, time)].dataType
    lo, hi = (same_kind(kind, t) for t in r)
    return known(column(df, time), column(df, time).between(lo, hi))


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[resolve(df, name)].dataType, (*NUMERIC, *TIMES))


def _number(df: DataFrame, name: str) -> Column:
    """A column as double: timestamps as epoch milliseconds, text and booleans as nothing."""
    kind, c = df.schema[resolve(df, name)].dataType, column(df, name)
    if isinstance(kind, NUMERIC):
        return c.cast("double")
    if isinstance(kind, TIMES):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def bucket(c: Column, interval: str, tz: str, kind: T.DataType) -> Column:
    """The start of the interval that holds a time, in the zone, as a time without zone in UTC."""
    if not isinstance(kind, T.TimestampNTZType):
        c = F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")) if isinstance(kind, T.TimestampType) else c.cast("timestamp_ntz")
    local = c if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), c)
    cut = F.date_trunc(interval, local).cast("timestamp_ntz")
    return cut if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), cut)


def fill_gaps(out: DataFrame, time: Dimension, others: list[str], metrics: tuple[Metric, ...], current: Range | None) -> DataFrame:
    """Every bucket between the ends for each combination of the other dimensions: 0 for counts and sums, null for the rest."""
    step = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}[time.interval.lower()]
    t = F.col(f"`{time.alias}`")
    if current:
        lo, hi = (F.date_trunc(time.interval, F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")).cast("timestamp_ntz") for x in current)
    else:
        lo, hi = F.min(t), F.max(t)
    groups = out.groupBy(*others).agg((lo if not current else F.min(lo)).alias("__lo"), (hi if not current else F.min(hi)).alias("__hi"))
    all_times = groups.select(*(F.col(f"`{n}`").alias(f"__{n}") for n in others), F.explode(F.sequence("__lo", "__hi", F.expr(f"INTERVAL {step}"))).alias("__t"))
    on = [F.col("__t") == t, *(F.col(f"`__{n}`").eqNullSafe(F.col(f"`{n}`")) for n in others)]
    value = lambda m: F.coalesce(f"`{m.alias}`", F.lit(0.0)) if m.aggregation.upper() in ("COUNT", "SUM") else F.col(f"`{m.alias}`")
    return all_times.join(out, on, "left").select(F.col("__t").alias(time.alias), *(F.col(f"`__{n}`").alias(n) for n in others), *(value(m).alias(m.alias) for m in metrics))


def intelligence(row: DataFrame, current: str, previous: str, z: str | None = None) -> DataFrame:
    """delta, pct, direction, label and anomaly of a KPI row with both values."""
    c, p = F.col(current), F.col(previous)
    pct = F.when(p == 0, F.when(c > 0, 100.0).when(c < 0, -100.0).otherwise(0.0)).otherwise(F.try_divide(c - p, F.abs(p)) * 100)
    out = row.withColumn("delta", c - p).withColumn("pct", pct)
    d = F.col("delta")
    out = out.withColumn("direction", F.when(d > 0.001, "up").when(d < -0.001, "down").otherwise("flat"))
    out = out.withColumn("signal", F.concat(F.when(F.col("pct") >= 0, "+").otherwise(""), F.format_string("%.1f%%", "pct")))
    return out.withColumn("anomaly", F.abs(F.col(z)) > 2 if z else F.lit(False))


def merge_series(series: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of results on shared dimensions; values keep their names with the series' key before them."""
    parts = [df.select(*keys, *(F.col(c).alias(f"{k}_{c}") for c in df.columns if c not in keys)) for k, df in series.items()]
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), parts)


def merged_requests(requests: dict[str, Request], filters: tuple) -> dict[str, Request]:
    """Requests with more filters in front."""
    return {k: replace(r, filters=(*filters, *r.filters)) for k, r in requests.items()}
