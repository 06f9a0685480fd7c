"""Order-dependent statistics of series (subject, time, value), and rollups.

Sums over neighbours use ``lag`` windows per series; recursions are folds over
the series' sorted array. ``order`` must be unique within a series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _series(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    x = F.col(value).cast("double")
    return df.select(*by, *[c for c in order if c not in by], x.alias("x"), F.avg(x).over(W.partitionBy(*by)).alias("m"), F.lag(x, 1).over(w).alias("x1"), F.lag(x, 2).over(w).alias("x2"))


def autocorrelation(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """acf1, acf2 (within -1 and 1), Durbin-Watson (2 for a flat series), zero-crossing rate about the mean."""
    s = _series(df, by, order, value)
    d, d1, d2 = (F.col(c) - F.col("m") for c in ("x", "x1", "x2"))
    m2 = F.sum(d * d)
    acf = lambda e: F.greatest(F.least(F.coalesce(F.try_divide(F.sum(d * e), m2), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    cross = F.sum(F.when((d >= 0) != (d1 >= 0), 1.0).otherwise(0.0))
    return s.groupBy(*by).agg(F.count("*").alias("n"), acf(d1).alias("acf1"), acf(d2).alias("acf2"), F.coalesce(F.try_divide(F.sum((F.col("x") - F.col("x1")) ** 2), m2), F.lit(2.0)).alias("durbin_watson"),
                              F.coalesce(F.try_divide(cross, F.count("*") - 1), F.lit(0.0)).alias("zero_crossing"))


def first_last(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"))


def drift(df: DataFrame, by: Sequence[str], seconds: Column, value: str) -> DataFrame:
    """OLS slope on time and its studentised correlation."""
    x = F.col(value).cast("double")
    r = F.try_divide(F.covar_samp(x, seconds), F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(seconds)))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.coalesce(F.regr_slope(x, seconds), F.lit(0.0)).alias("slope"), F.coalesce(r, F.lit(0.0)).alias("r"))
    z = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), F.greatest(1 - F.col("r") ** 2, F.lit(1e-300)))))
    return out.withColumn("z", F.coalesce(z, F.lit(0.0)))


def _sorted(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    item = F.struct(*order, F.col(value).cast("double").alias("__x"))
    lists = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("s"))
    return lists.select(*by, F.transform("s", lambda e: e["__x"]).alias("xs"))


def ema(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, fast: float = 0.25, slow: float = 0.05) -> DataFrame:
    """Fast and slow exponential means of each series at its end, seeded with the first value, and their difference."""
    fold = lambda a: F.aggregate("xs", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(a * x + (1 - a) * s))
    return _sorted(df, by, order, value).select(*by, fold(fast).alias("ema_fast"), fold(slow).alias("ema_slow")).withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))


def cusum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Largest upper and lower cumulative sums of standardised values beyond ``k``, and whether one passes ``h``."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
    s = _sorted(df, by, order, value).join(stats, list(by))
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0.0).alias("most_up"), F.lit(0.0).alias("most_down"))

    def step(a, x):
        z = F.coalesce(F.try_divide(x - F.col("m"), F.col("sd")), F.lit(0.0))
        up, down = F.greatest(F.lit(0.0), a.up + z - k), F.greatest(F.lit(0.0), a.down - z - k)
        return F.struct(up.alias("up"), down.alias("down"), F.greatest(a.most_up, up).alias("most_up"), F.greatest(a.most_down, down).alias("most_down"))

    out = s.select(*by, F.aggregate("xs", zero, step).alias("c"))
    return out.select(*by, F.col("c.most_up").alias("cusum_up"), F.col("c.most_down").alias("cusum_down"), (F.greatest("c.most_up", "c.most_down") > h).alias("alarm"))


def prefix_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w))


def range_sum(df: DataFrame, at: str, lo, hi, value: str) -> DataFrame:
    return df.where(F.col(at).between(F.lit(lo), F.lit(hi))).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


#: Levels of the pyramid.
LEVELS = {"1m": "minute", "1h": "hour", "1d": "day"}


def pyramid(df: DataFrame, subject: str, time: str, value: str, level: str = "1h") -> DataFrame:
    """(subject, bucket, n, sum, min, max, first, last)."""
    t = F.date_trunc(LEVELS[level], time).cast("timestamp_ntz")
    return df.groupBy(subject, t.alias("bucket")).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"))


def roll_pyramid(lower: DataFrame, subject: str, level: str) -> DataFrame:
    """A coarser level from a finer one."""
    t = F.date_trunc(LEVELS[level], "bucket").cast("timestamp_ntz")
    return lower.groupBy(subject, t.alias("bucket")).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.min_by("first", "bucket").alias("first"), F.max_by("last", "bucket").alias("last"))


def steady_steps(df: DataFrame, by: Sequence[str], order: Sequence[str], time: Column) -> DataFrame:
    """Share of zeros among second differences of time: how regular a series comes."""
    w = W.partitionBy(*by).orderBy(*order)
    d1 = time - F.lag(time, 1).over(w)
    s = df.select(*by, *order, d1.alias("d1"))
    s = s.withColumn("d2", F.col("d1") - F.lag("d1", 1).over(w))
    return s.groupBy(*by).agg(F.coalesce(F.try_divide(F.count_if(F.col("d2") == 0), F.count("d2")), F.lit(0.0)).alias("zero_ratio"))


def _spectrum(x: np.ndarray, rate: float) -> tuple[float, float, list[float], float]:
    x = x[:256] - x[:256].mean()
    if len(x) < 4:
        return 0.0, 0.0, [0.0] * 8, 0.0
    power = np.abs(np.fft.rfft(x))[1:] ** 2 / len(x)
    bands = [float(b.sum()) for b in np.array_split(power, 8)]
    p = power / power.sum() if power.sum() > 0 else np.full(len(power), 0.0)
    entropy = float(-(p[p > 0] * np.log(p[p > 0])).sum() / np.log(len(p))) if len(p) > 1 else 0.0
    k = int(np.argmax(power))
    return (k + 1) * rate / len(x), float(power[k]), bands, entropy


def spectrum(df: DataFrame, by: str, order: str, value: str, rate: float) -> DataFrame:
    """Dominant frequency and its power, power in eight bands, normalised entropy, of each series' first 256 values."""
    kind = dict(df.dtypes)[by]
    first = df.withColumn("__at", F.row_number().over(W.partitionBy(by).orderBy(order))).where("__at <= 256")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _spectrum(pdf.sort_values("__at")["x"].to_numpy(float), rate)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "frequency": [got[0]], "power": [got[1]], "bands": [got[2]], "entropy": [got[3]]})

    return first.select(by, "__at", F.col(value).cast("double").alias("x")).groupBy(by).applyInPandas(run, f"{by} {kind}, frequency double, power double, bands array<double>, entropy double")


def goertzel(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, frequency: float, rate: float) -> DataFrame:
    """Power of one frequency, by the two-term recursion as a fold."""
    coeff = 2 * float(np.cos(2 * np.pi * frequency / rate))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    s = _sorted(df, by, order, value).select(*by, F.aggregate("xs", zero, lambda s, x: F.struct((x + coeff * s.a - s.b).alias("a"), s.a.alias("b"))).alias("g"), F.size("xs").alias("n"))
    return s.select(*by, F.try_divide(F.col("g.a") ** 2 + F.col("g.b") ** 2 - coeff * F.col("g.a") * F.col("g.b"), F.col("n")).alias("power"))
