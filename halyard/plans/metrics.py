"""Metrics: names to aggregate expressions. Only existing numeric values count; an empty input gives 0, not null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class MetricError(ValueError):
    pass


def rank_percentile(name: str, p: float) -> Column:
    """The value at place ``min(floor(p * n), n - 1)`` of the column's sorted values, counting from 0.

    That is the discrete percentile of a share just above ``p``, whose state
    (values with their counts) is combined before the shuffle.
    """
    return F.expr(f"percentile_disc({min(p + 1e-12, 1.0)!r}D) WITHIN GROUP (ORDER BY `{name}`)")


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson over rows that have both; 0 without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(y, x), F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(y)))


def logistic_slope(x: str, y: str, steps: int = 8, ridge: float = 1e-6) -> Column:
    """Slope of a one-feature logistic regression of ``y`` (0 or not) on ``x``, by reweighted least squares; null with one class.

    The group's pairs are folded over in place, so they must fit one task; for a whole table use the statistics module's stepwise fit.
    """
    pairs = F.collect_list(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), (F.col(y) != 0).cast("double").alias("y"))))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("g0", "g1", "w0", "w1", "w2")))

    def sums(b):
        def add(s, e):
            z = F.greatest(F.least(b.b0 + b.b1 * e.x, F.lit(35.0)), F.lit(-35.0))
            p = 1 / (1 + F.exp(-z))
            w = p * (1 - p)
            return F.struct((s.g0 + e.y - p).alias("g0"), (s.g1 + (e.y - p) * e.x).alias("g1"), (s.w0 + w).alias("w0"), (s.w1 + w * e.x).alias("w1"), (s.w2 + w * e.x * e.x).alias("w2"))

        return F.aggregate(pairs, zero, add)

    def step(b, _):
        def solve(s):
            a, c, d = s.w0 + ridge, s.w1, s.w2 + ridge
            det = a * d - c * c
            return F.struct((b.b0 + F.coalesce(F.try_divide(d * s.g0 - c * s.g1, det), F.lit(0.0))).alias("b0"), (b.b1 + F.coalesce(F.try_divide(a * s.g1 - c * s.g0, det), F.lit(0.0))).alias("b1"))

        return F.element_at(F.transform(F.array(sums(b)), solve), 1)

    start = F.struct(F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"))
    slope = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["b1"]
    both = F.max(F.when(F.col(x).isNotNull(), (F.col(y) != 0).cast("int"))) != F.min(F.when(F.col(x).isNotNull(), (F.col(y) != 0).cast("int")))
    return F.when(both, slope)


@dataclass(frozen=True)
class Aggregate:
    """``build`` gets the names of the columns of the metric's values and the secondary ones, both doubles with null where there is none."""

    build: Callable[[str, str | None], Column]
    secondary: bool = False
    empty: float | None = 0.0


AGGREGATES: dict[str, Aggregate] = {
    "SUM": Aggregate(lambda x, _: F.sum(x)), "AVG": Aggregate(lambda x, _: F.avg(x)), "MIN": Aggregate(lambda x, _: F.min(x)), "MAX": Aggregate(lambda x, _: F.max(x)),
    "MEDIAN": Aggregate(lambda x, _: rank_percentile(x, 0.5)), "P90": Aggregate(lambda x, _: rank_percentile(x, 0.9)), "P95": Aggregate(lambda x, _: rank_percentile(x, 0.95)), "P99": Aggregate(lambda x, _: rank_percentile(x, 0.99)),
    "STD_DEV": Aggregate(lambda x, _: F.stddev_samp(x)), "VARIANCE": Aggregate(lambda x, _: F.var_samp(x)),
    "CORRELATION": Aggregate(lambda x, y: correlation(F.col(x), F.col(y)), True), "LINEAR_REGRESSION": Aggregate(lambda y, x: F.regr_slope(y, x), True),
    "LOGISTIC_REGRESSION": Aggregate(lambda y, x: logistic_slope(x, y), True, None),
    "COUNT_DISTINCT": Aggregate(lambda x, _: F.count_distinct(x)), "APPROX_DISTINCT": Aggregate(lambda x, _: F.approx_count_distinct(x)),
    # bounded state for groups of any size, where an exact rank is not asked for
    **{f"APPROX_P{q}": Aggregate(lambda x, _, q=q: F.percentile_approx(x, q / 100, 10_000)) for q in (50, 90, 95, 99)},
}


def alias_of(fn: str, attribute: str, name: str | None = None) -> str:
    return name or f"{fn.lower()}_{attribute.rsplit('/', 1)[-1]}"


def metric_column(fn: str, values: str | None, secondary: str | None = None, rows: str | None = None) -> Column:
    """The aggregate of a column of doubles (None: no numeric attribute, which counts rows); ``rows``: not null where a row counts."""
    fn = fn.upper()
    if fn == "COUNT":
        rows = F.count(rows if rows else F.lit(1))
        if values is None:
            return rows.cast("double")
        seen = F.count(values)
        return F.when(seen > 0, seen).otherwise(rows).cast("double")
    if fn not in AGGREGATES:
        raise MetricError(f"unknown aggregation {fn!r}")
    if values is None:
        return F.lit(0.0)
    if AGGREGATES[fn].secondary and secondary is None:
        raise MetricError(f"{fn} needs a secondary attribute")
    out = AGGREGATES[fn].build(values, secondary)
    return _zero(out) if AGGREGATES[fn].empty is not None else out.cast("double")


def register_aggregate(name: str, build: Callable[[str, str | None], Column], secondary: bool = False) -> None:
    """Add an aggregation to the request language."""
    AGGREGATES[name.upper()] = Aggregate(build, secondary)
