"""Fixed-point ledger: four decimals, banker's rounding.

Products are taken at DECIMAL(18,4) so that their scale is kept before they are rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MONEY = "decimal(18,4)"
WIDE = "decimal(38,4)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def mul(a: Column, b: Column) -> Column:
    return F.bround(money(a) * money(b), 4).cast(WIDE)


def div(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.bround(F.try_divide(a.cast("decimal(28,4)"), money(b)), 4).cast(WIDE)


def add(a: Column, b: Column) -> Column:
    """Null where the sum does not fit."""
    return F.try_add(a.cast(WIDE), b.cast(WIDE)).try_cast(WIDE)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a.cast(WIDE), b.cast(WIDE)).try_cast(WIDE)


def convert(df: DataFrame, amount: str, currency: str, rates: DataFrame, to: str = "base_amount") -> DataFrame:
    """Amounts in the base currency; rates are (currency, rate), one row a currency. No rate gives null."""
    r = rates.select(F.col("currency").alias("__currency"), F.col("rate").alias("__rate"))
    return df.join(r, F.col(currency) == F.col("__currency"), "left").withColumn(to, mul(F.col(amount), F.col("__rate"))).drop("__currency", "__rate")


def allocate(df: DataFrame, total: Column, weight: str, index: str, by: Sequence[str] = (), unit: int = 4) -> DataFrame:
    """Largest remainders: ``share`` of each row in whole 10^-unit; what is left goes to the largest remainders, ties by index. Sums exactly to the total."""
    scale = 10**unit
    w = W.partitionBy(*by)
    out = df.withColumn("__units", F.round(total.cast("decimal(28,4)") * scale).cast("decimal(28,0)"))
    exact = F.try_divide(F.col("__units") * F.col(weight).cast(MONEY), F.sum(F.col(weight).cast(MONEY)).over(w))
    out = out.withColumn("__exact", F.coalesce(exact, F.lit(0))).withColumn("__floor", F.floor("__exact"))
    out = out.withColumn("__left", F.col("__units") - F.sum("__floor").over(w)).withColumn("__rank", F.row_number().over(w.orderBy(F.desc(F.col("__exact") - F.col("__floor")), index)))
    share = (F.col("__floor") + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0)) / F.lit(scale)
    return out.withColumn("share", share.cast(WIDE)).drop("__units", "__exact", "__floor", "__left", "__rank")


def issue(batches: DataFrame, issues: DataFrame, item: str, method: str = "FIFO") -> DataFrame:
    """(item, issue_id, quantity, cogs) of a sequence of issues against the batches received.

    batches: item, batch_id, received_at, expires_at, quantity, unit_cost. issues: item, issue_id, issued_at, quantity.
    FIFO and FEFO take batches in one fixed order, so an issue's cost is the
    overlap of two running sums; LIFO and WAC depend on the state at each issue and are
    walked per item.
    """
    if method.upper() in ("FIFO", "FEFO"):
        first = ["received_at", "batch_id"] if method.upper() == "FIFO" else ["expires_at", "received_at", "batch_id"]
        run = lambda order: F.sum("quantity").over(W.partitionBy(item).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        b = batches.withColumn("hi", run(first)).select(F.col(item).alias("__item"), (F.col("hi") - F.col("quantity")).alias("blo"), F.col("hi").alias("bhi"), "unit_cost")
        i = issues.withColumn("hi", run(["issued_at", "issue_id"])).withColumn("lo", F.col("hi") - F.col("quantity"))
        met = i.join(b, (F.col(item) == F.col("__item")) & (F.col("lo") < F.col("bhi")) & (F.col("blo") < F.col("hi")))
        took = F.least("hi", "bhi") - F.greatest("lo", "blo")
        costs = met.groupBy(F.col(item).alias("__i"), F.col("issue_id").alias("__id")).agg(F.sum(took).alias("filled"), F.sum(took * F.col("unit_cost")).alias("cogs"))
        out = issues.join(costs, (F.col(item) == F.col("__i")) & (F.col("issue_id") == F.col("__id")), "left")
        return out.select(item, "issue_id", "quantity", F.coalesce("filled", F.lit(0.0)).alias("filled"), F.bround(F.coalesce("cogs", F.lit(0.0)), 4).alias("cogs"))
    kind = dict(batches.dtypes)[item]
    events = batches.select(item, F.lit(0).alias("kind"), F.col("received_at").alias("at"), F.col("batch_id").cast("string").alias("id"), F.col("quantity").cast("double").alias("q"), F.col("unit_cost").cast("double").alias("c"))
    events = events.unionByName(issues.select(item, F.lit(1).alias("kind"), F.col("issued_at").alias("at"), F.col("issue_id").cast("string").alias("id"), F.col("quantity").cast("double").alias("q"), F.lit(None).cast("double").alias("c")))

    def walk(batches):
        # rows come item by item in order of time; only the stock of one item is held
        now, stock = object(), []
        for b in batches:
            rows = []
            cols = [b.column(c).to_pylist() for c in (item, "kind", "id")] + [b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("q", "c")]
            for key, what, name, q, c in zip(*cols, strict=True):
                if key != now:
                    now, stock = key, []
                if what == 0:
                    stock.append([q, c])
                    continue
                left, cost = q, 0.0
                if method.upper() == "WAC":
                    have = sum(q for q, _ in stock)
                    mean = sum(q * c for q, c in stock) / have if have else 0.0
                    took = min(left, have)
                    cost, left = took * mean, left - took
                    stock = [[have - took, mean]]
                else:
                    while left > 0 and stock:
                        took = min(left, stock[-1][0])
                        cost, left = cost + took * stock[-1][1], left - took
                        stock[-1][0] -= took
                        if stock[-1][0] <= 0:
                            stock.pop()
                rows.append((key, name, q, q - left, float(Decimal(repr(cost)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(item).type), pa.array(cols[1], pa.string()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=[item, "issue_id", "quantity", "filled", "cogs"])

    ordered = events.repartition(item).sortWithinPartitions(item, F.asc_nulls_last("at"), "kind", F.asc_nulls_last("id"))
    return ordered.mapInArrow(walk, f"{item} {kind}, issue_id string, quantity double, filled double, cogs double")


def running_wac(batches: DataFrame, item: str) -> DataFrame:
    """Running quantity, book value and weighted average cost after each receipt."""
    w = W.partitionBy(item).orderBy("received_at", "batch_id").rowsBetween(W.unboundedPreceding, 0)
    out = batches.withColumn("running_quantity", F.sum("quantity").over(w)).withColumn("book_value", F.sum(F.col("quantity") * F.col("unit_cost")).over(w))
    return out.withColumn("wac", F.try_divide("book_value", "running_quantity"))


def as_of(points: DataFrame, facts: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Each point with the last fact at or before it: one window over both, no join."""
    both = points.select(*by, time, F.lit(None).cast(dict(facts.dtypes)[value]).alias(value), F.lit(1).alias("__p")).unionByName(facts.select(*by, time, value, F.lit(0).alias("__p")))
    w = W.partitionBy(*by).orderBy(time, "__p").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__p = 1").drop("__p")


def unbalanced(journal: DataFrame, entry: str, locked_before=None, date: str = "posted_at") -> DataFrame:
    """(entry, debit, credit, reason) of entries that don't balance or lie in a locked period."""
    sums = journal.groupBy(entry).agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.min(date).alias("first"))
    reason = F.when(F.round("debit", 4) != F.round("credit", 4), F.lit("unbalanced"))
    if locked_before is not None:
        reason = reason.when(F.col("first") < F.lit(locked_before), F.lit("locked"))
    return sums.withColumn("reason", reason).where("reason is not null").select(entry, "debit", "credit", "reason")


def hash_chain(entries: DataFrame, by: str, order: Sequence[str], content: Column) -> DataFrame:
    """(by, head): each chain's last hash, every link over the one before and its entry's content."""
    lists = entries.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, content.alias("c")))).alias("l"))
    return lists.select(by, F.aggregate("l", F.lit("0" * 64), lambda h, e: F.sha2(F.concat(h, e.c), 256)).alias("head"))


def py_chain(contents: list[str]) -> str:
    head = "0" * 64
    for c in contents:
        head = hashlib.sha256((head + c).encode()).hexdigest()
    return head


def amortise(cost: Column, salvage: Column, capacity: Column, used: Column) -> Column:
    """Straight line by use; the share used is rounded to four decimals first."""
    return F.bround((money(cost) - money(salvage)) * F.bround(money(used) / money(capacity), 4).cast("decimal(10,4)"), 4).cast(WIDE)
