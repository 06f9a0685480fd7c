"""Statistics as aggregate expressions and small solvers.

Everything that grows with the data is a Spark aggregate; the driver only
solves systems whose size is the number of variables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def moments(x: Column) -> dict[str, Column]:
    """Count, mean, sample variance, deviation and variation, population skewness and excess kurtosis, Jarque-Bera; 0 where too few values or no variance."""
    n = F.count(x)
    skew, kurt = F.when(n >= 3, _zero(F.skewness(x))).otherwise(0.0), F.when(n >= 4, _zero(F.kurtosis(x))).otherwise(0.0)
    return {"n": n, "mean": F.avg(x), "variance": _zero(F.var_samp(x)), "std": _zero(F.stddev_samp(x)), "cv": _zero(F.try_divide(F.stddev_samp(x), F.avg(x))),
            "skewness": skew, "kurtosis": kurt, "jarque_bera": n / 6 * (skew * skew + kurt * kurt / 4)}


def means(x: Column) -> dict[str, Column]:
    """Geometric and harmonic means: sums over positive values, divided by all; root mean square and crest factor."""
    n, up = F.count(x), F.when(x > 0, x)
    rms = F.sqrt(F.avg(x * x))
    return {"geometric": _zero(F.exp(F.try_divide(F.sum(F.ln(up)), n))), "harmonic": _zero(F.try_divide(n.cast("double"), F.sum(1 / up))), "rms": rms, "crest": _zero(F.try_divide(F.max(F.abs(x)), rms))}


QUANTILES = (0.001, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.995, 0.999, 0.9999)


def quantiles(x: Column, at: Sequence[float] = QUANTILES) -> Column:
    """Quantiles with linear interpolation."""
    return F.percentile(x, [float(q) for q in at])


def robust(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """median, q1, q3, iqr, Tukey fences, MAD and 5 % trimmed mean of each group; a pass for the quantiles and one for what depends on them."""
    x = F.col(value)
    by = list(by)
    first = df.groupBy(*by).agg(F.percentile(x, [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"))
    joined = _with(df, first, by)
    inside = F.when((x >= F.col("q")[0]) & (x <= F.col("q")[4]), x)
    second = joined.groupBy(*by).agg(F.first("q").alias("q"), F.percentile(F.abs(x - F.col("q")[2]), 0.5).alias("mad"), F.avg(inside).alias("trimmed_mean"))
    q = F.col("q")
    iqr = q[3] - q[1]
    return second.select(*by, q[2].alias("median"), q[1].alias("q1"), q[3].alias("q3"), iqr.alias("iqr"), (q[1] - 1.5 * iqr).alias("low_fence"), (q[3] + 1.5 * iqr).alias("high_fence"), "mad", "trimmed_mean")


def _with(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Group statistics beside each row: by key, or the one row that there is without a key."""
    return df.join(stats, by) if by else df.withColumn("__one", F.lit(1)).join(F.broadcast(stats.withColumn("__one", F.lit(1))), "__one").drop("__one")


def outliers(df: DataFrame, value: str, by: Sequence[str] = (), limit: float = 3.5) -> DataFrame:
    """Rows with ``modified_z`` = 0.6745 |x - median| / MAD above the limit."""
    out = _with(df, robust(df, value, by).select(*by, "median", "mad"), list(by))
    z = F.coalesce(F.try_divide(0.6745 * F.abs(F.col(value) - F.col("median")), F.col("mad")), F.lit(0.0))
    return out.withColumn("modified_z", z).where(F.col("modified_z") > limit).drop("median", "mad")


def co_moments(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and the matrix of centred cross products over rows that have all values: one aggregation, one row."""
    names = list(names)
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    c = np.zeros((len(names), len(names)))
    for i, j in pairs:
        c[i, j] = c[j, i] = (got[f"c{i}_{j}"] or 0.0) * got["n"]
    return got["n"], np.array([got[f"m{i}"] or 0.0 for i in range(len(names))]), c


def pearson_matrix(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Correlations; 0 without variance, 1 on the diagonal."""
    _, _, c = co_moments(df, names)
    d = np.sqrt(np.diag(c))
    out = np.divide(c, np.outer(d, d), out=np.zeros_like(c), where=np.outer(d, d) > 0)
    np.fill_diagonal(out, 1.0)
    return out.clip(-1, 1)


def spearman_approx(r: float) -> float:
    return 6 / math.pi * math.asin(r / 2)


def spearman(df: DataFrame, x: str, y: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation per group; ties rank by the order columns."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.row_number().over(W.partitionBy(*by).orderBy(c, *order)).cast("double")
    r = pairs.withColumn("rx", rank(x)).withColumn("ry", rank(y))
    return r.groupBy(*by).agg(_zero(F.try_divide(F.covar_samp("rx", "ry"), F.sqrt(F.var_samp("rx") * F.var_samp("ry")))).alias("spearman"))


def ols(df: DataFrame, y: str, xs: Sequence[str], ridge: float = 1e-9) -> dict[str, float]:
    """Coefficients by name, ``intercept`` and ``r2``."""
    _, m, c = co_moments(df, [*xs, y])
    k = len(xs)
    b = np.linalg.solve(c[:k, :k] + ridge * np.eye(k), c[:k, k])
    r2 = float(b @ c[:k, k] / c[k, k]) if c[k, k] > 0 else 0.0
    return {**dict(zip(xs, map(float, b), strict=True)), "intercept": float(m[k] - b @ m[:k]), "r2": r2}


def principal_component(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, float]:
    """The first component (its largest weight positive) and its share of the variance."""
    _, _, c = co_moments(df, names)
    values, vectors = np.linalg.eigh(c)
    v = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
    return v, float(values[-1] / values.sum()) if values.sum() > 0 else 0.0


def mahalanobis(df: DataFrame, names: Sequence[str], ridge: float = 1e-6) -> DataFrame:
    """``distance`` of each row from the mean, as a quadratic form of columns."""
    n, m, c = co_moments(df, names)
    inverse = np.linalg.inv(c / max(n - 1, 1) + ridge * np.eye(len(names)))
    d = [F.col(x).cast("double") - float(v) for x, v in zip(names, m, strict=True)]
    total = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.withColumn("distance", F.sqrt(F.greatest(total, F.lit(0.0))))


def logistic(df: DataFrame, x: str, y: str, steps: int = 8, ridge: float = 1e-6) -> tuple[float, float, int] | None:
    """(intercept, slope, steps) by reweighted least squares; each step is one aggregation of five sums. None with one class only."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    if rows.agg(F.count_distinct("y")).first()[0] < 2:
        return None
    b0 = b1 = 0.0
    for k in range(1, steps + 1):
        z = F.greatest(F.least(F.lit(b0) + F.lit(b1) * F.col("x"), F.lit(35.0)), F.lit(-35.0))
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        s = rows.agg(F.sum(F.col("y") - p), F.sum((F.col("y") - p) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        a = np.array([[s[2] + ridge, s[3]], [s[3], s[4] + ridge]])
        step = np.linalg.solve(a, [s[0], s[1]])
        b0, b1 = b0 + step[0], b1 + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(b0), float(b1), k


def benford(df: DataFrame, value: str) -> DataFrame:
    """(digit, n, expected) of first digits of non-zero values."""
    a = F.abs(F.col(value).cast("double"))
    digit = F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(a)))).cast("int")
    digit = F.least(F.greatest(digit, F.lit(1)), F.lit(9))
    counts = df.where(a > 0).groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))
    share = F.log10(1 + 1 / F.col("digit"))
    return counts.select("digit", "n", (share * F.sum("n").over(W.partitionBy())).alias("expected"))  # nine rows


def benford_chi2(df: DataFrame, value: str) -> DataFrame:
    """(chi2, conforms): against 15.51, the 95 % point of eight degrees of freedom."""
    d = benford(df, value)
    missing = 1 - F.sum(F.log10(1 + 1 / F.col("digit")))
    chi2 = F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")) + missing * F.sum("n")
    return d.agg(chi2.alias("chi2")).withColumn("conforms", F.col("chi2") <= 15.51)


def markov(df: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """(from_state, to_state, n, p): transitions within each key, and the share of those from the state."""
    nxt = F.lead(state).over(W.partitionBy(key).orderBy(*order))
    counts = df.select(F.col(state).alias("from_state"), nxt.alias("to_state")).where("to_state is not null").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("from_state")))


def transition_matrix(transitions: DataFrame) -> tuple[list, np.ndarray]:
    """States in order and their matrix; a state that nothing leaves keeps itself. As large as the states squared."""
    rows = transitions.select("from_state", "to_state", "p").collect()
    states = sorted({r[0] for r in rows} | {r[1] for r in rows})
    m = np.zeros((len(states), len(states)))
    for a, b, p in rows:
        m[states.index(a), states.index(b)] = p
    empty = m.sum(axis=1) == 0
    m[empty, empty] = 1.0
    return states, m


def steady_state(m: np.ndarray, steps: int = 48) -> np.ndarray:
    v = np.full(len(m), 1 / len(m))
    for _ in range(steps):
        v = v @ m
    return v


def n_step(m: np.ndarray, i: int, j: int, n: int) -> float:
    return float(np.linalg.matrix_power(m, n)[i, j])


# reliability


def weibull_fit(t: np.ndarray, failed: np.ndarray) -> tuple[float, float] | None:
    """(shape, scale) of right-censored times: Menon's start, five Newton steps on the likelihood, shape within 0.2 and 15."""
    t, failed = np.asarray(t, float), np.asarray(failed, bool)
    failed, t = failed[t > 0], t[t > 0]
    if failed.sum() < 2:
        return None
    logs = np.log(t)
    spread = logs[failed].std(ddof=1)
    beta = min(max(math.pi / (math.sqrt(6) * spread), 0.2), 15.0) if spread > 0 else 15.0
    for _ in range(5):
        w = t**beta
        s0, s1, s2 = w.sum(), (w * logs).sum(), (w * logs * logs).sum()
        g = s1 / s0 - 1 / beta - logs[failed].mean()
        slope = (s2 * s0 - s1 * s1) / s0**2 + 1 / beta**2
        beta = min(max(beta - g / slope, 0.2), 15.0)
    return beta, float((t**beta).sum() / failed.sum()) ** (1 / beta)


def weibull_by(df: DataFrame, by: str, time: str, failed: str) -> DataFrame:
    """(by, shape, scale, mean_life) of each group; a group's observations meet in one task."""
    kind = dict(df.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = weibull_fit(pdf["t"].to_numpy(), pdf["f"].to_numpy())
        shape, scale = got or (None, None)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "shape": [shape], "scale": [scale], "mean_life": [scale * math.gamma(1 + 1 / shape) if got else None]})

    return df.select(by, F.col(time).cast("double").alias("t"), F.col(failed).cast("boolean").alias("f")).groupBy(by).applyInPandas(run, f"{by} {kind}, shape double, scale double, mean_life double")


def weibull_survival(t: Column, shape: Column, scale: Column, location: Column | None = None) -> Column:
    z = F.greatest(t - location, F.lit(0.0)) if location is not None else t
    return F.exp(-F.pow(z / scale, shape))


def weibull_hazard(t: Column, shape: Column, scale: Column) -> Column:
    return shape / scale * F.pow(t / scale, shape - 1)


def replacement_interval(shape: float, scale: float, preventive: float, corrective: float) -> float | None:
    """Age of preventive replacement by the ratio of costs; None where wear is too weak (shape up to 1.05) or it doesn't pay."""
    if shape <= 1.05 or corrective <= preventive:
        return None
    return scale * (preventive / ((corrective - preventive) * (shape - 1))) ** (1 / shape)


def kaplan_meier(df: DataFrame, time: str, failed: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, time, at_risk, failures, survival): the product-limit estimate at each time with a failure."""
    by = list(by)
    at = df.groupBy(*by, F.col(time).alias("time")).agg(F.sum(F.col(failed).cast("int")).alias("failures"), F.count("*").alias("left"))
    later = F.sum("left").over(W.partitionBy(*by).orderBy(F.desc("time")).rowsBetween(W.unboundedPreceding, 0))
    risk = at.withColumn("at_risk", later).where("failures > 0")
    step = F.when(F.col("failures") < F.col("at_risk"), F.ln(1 - F.col("failures") / F.col("at_risk"))).otherwise(F.lit(-1e9))
    total = F.sum(step).over(W.partitionBy(*by).orderBy("time").rowsBetween(W.unboundedPreceding, 0))
    return risk.select(*by, "time", "at_risk", "failures", F.exp(total).alias("survival"))


def renewal_kpis(df: DataFrame, up: str, down: str, by: Sequence[str] = ()) -> DataFrame:
    """failures, MTTR, MTBF, MTTF and availability from up and down times of each failure."""
    return df.groupBy(*by).agg(F.count("*").alias("failures"), F.avg(down).alias("mttr"), (F.avg(up) + F.avg(down)).alias("mtbf"), F.avg(up).alias("mttf"), _zero(F.try_divide(F.sum(up), F.sum(up) + F.sum(down))).alias("availability"))


def availability(mtbf: Column, mttr: Column) -> Column:
    return _zero(F.try_divide(mtbf, mtbf + mttr))


# inventory


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, error below 7.5e-8."""
    k = 1 / (1 + 0.2316419 * F.abs(z))
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def eoq(demand: Column, order_cost: Column, holding: Column) -> Column:
    """Economic order quantity; 0 where holding costs nothing."""
    return F.when((holding > 0) & (demand > 0), F.sqrt(2 * demand * order_cost / F.when(holding > 0, holding))).otherwise(0.0)


def safety_stock(z: float, std: Column, lead: Column) -> Column:
    return F.lit(z) * std * F.sqrt(lead)


def reorder_point(daily: Column, lead: Column, safety: Column) -> Column:
    return daily * lead + safety


# units

#: Fixed values: (factor, offset) to the base unit.
UNITS = {"c": (1.0, 0.0), "f": (5 / 9, -160 / 9), "k": (1.0, -273.15), "m": (1.0, 0.0), "km": (1000.0, 0.0), "ft": (0.3048, 0.0), "in": (0.0254, 0.0), "kg": (1.0, 0.0), "lb": (0.45359237, 0.0), "bar": (1.0, 0.0), "psi": (0.0689475729, 0.0), "kw": (1.0, 0.0), "hp": (0.745699872, 0.0)}


def affine(x: Column, factor: float, offset: float) -> Column:
    return x * factor + offset


def inverse(factor: float, offset: float) -> tuple[float, float]:
    return 1 / factor, -offset / factor


def compose(first: tuple[float, float], then: tuple[float, float]) -> tuple[float, float]:
    return first[0] * then[0], first[1] * then[0] + then[1]


def to_base(x: Column, unit: Column) -> Column:
    """A value in its base unit; an unknown unit leaves it as it is."""
    out = x
    for name, (factor, offset) in UNITS.items():
        out = F.when(F.lower(unit) == name, affine(x, factor, offset)).otherwise(out)
    return out


# mergeable summaries


def synopsis(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Sufficient statistics of blocks of rows, to be merged later: n, nulls, s1..s4 (centred within the block), mean, low, high, and a distinct sketch."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
                               F.min(x).alias("low"), F.max(x).alias("high"), F.hll_sketch_agg(x.cast("string")).alias("distinct"), F.kll_sketch_agg_double(x.cast("double")).alias("spread"))


def merge_synopses(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One summary of many: exact n, mean, variance and range; the sketches' estimates of distinct values and median."""
    n, mean = F.col("n").cast("double"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    second = F.sum(F.coalesce("m2", F.lit(0.0)) + n * F.coalesce("mean", F.lit(0.0)) * F.coalesce("mean", F.lit(0.0)))
    return blocks.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), mean.alias("mean"), F.try_divide(second - F.sum("n") * mean * mean, F.sum("n") - 1).alias("variance"),
                                   F.min("low").alias("low"), F.max("high").alias("high"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"))


def pruned(blocks: DataFrame, low=None, high=None) -> DataFrame:
    """Blocks that can hold a value of the range."""
    if low is not None:
        blocks = blocks.where(F.col("high") >= low)
    return blocks.where(F.col("low") <= high) if high is not None else blocks
