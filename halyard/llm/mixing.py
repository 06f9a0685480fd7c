"""Mixing sources to target weights on a low-discrepancy schedule, in Spark operations only.

Targets share a budget by weight; none exceeds ``most`` times its source's
words, and what a capped source leaves is shared among the others by weight.
Slots take the points of the golden-ratio sequence through the targets'
cumulative shares to sources and are ranked per source. Each source's
documents, in a hashed order, form a stream that repeats; equal blocks of
its words are joined to the source's slots in rank order. The last block ends at the target.

Ranks and positions are sums over chunks first and then within a chunk, so no
source's rows meet in one task. Only ids, sources and sizes are shuffled.

Defined cases: a null text has no words and is never taken, but has its row;
null sources are one source, the last in order; repeated rows are documents of their own;
a source without words has target 0; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import Scratch

GOLDEN = (5**0.5 - 1) / 2
CELLS = 4096
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where null equals null; keys are the left side's."""
    right = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    on = [left[c].eqNullSafe(right[f"_{c}"]) if c == "source" else left[c] == right[f"_{c}"] for c in keys]
    return left.join(right, on, how).drop(*(f"_{c}" for c in keys))


def mixing_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size); a row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on, so the windows without a key are as small as that
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), rank + 1))
    cap = F.col("source_size") * float(most)
    order = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    by = by.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * float(share))
    spent = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", (F.col("budget") - spent) / rest).withColumn("own", cap / F.col("weight"))
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("own"), F.struct("own", "level"))).over(W.partitionBy())["level"])
    return by.select("source", "source_size", F.least(cap, F.coalesce(F.col("weight") * F.col("level"), cap)).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(source, k, slot): the slot of each source's k-th block."""
    need = targets.withColumn("take", F.round("target").cast("long")).where("take > 0").withColumn("blocks", F.ceil(F.col("take") / block))
    all_take = F.sum("take").over(W.partitionBy())
    order = W.orderBy(F.col("source").asc_nulls_last())
    high = F.sum("take").over(order) / all_take
    need = need.withColumn("high", high).withColumn("low", F.col("high") - F.col("take") / all_take).withColumn("slots", F.sum("blocks").over(W.partitionBy()))
    cells = need.select("source", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS - 1e-6), F.floor(F.col("high") * CELLS + 1e-6))).alias("cell"))
    total = need.agg(F.max("slots")).first()[0] or 0
    i = F.col("id")
    far = F.lit((CHUNK * GOLDEN) % 1.0)
    point = F.pmod(F.pmod(F.floor(i / CHUNK) * far, F.lit(1.0)) + (i % CHUNK) * F.lit(GOLDEN), F.lit(1.0))
    slots = targets.sparkSession.range(total).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = slots.join(cells, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("source", "blocks", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("chunk")) - F.col("n"))
    ranked = hit.withColumn("r", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = meet(ranked, before.drop("n"), ["source", "chunk"]).select("source", "blocks", "slot", (F.col("r") + F.col("before")).alias("k"))
    # the points give each source its blocks but for the sequence's discrepancy; what is missing comes last, what is over goes
    have = counts.groupBy("source").agg(F.sum("n").alias("have"))
    lack = meet(need, have, ["source"], "left").select("source", "blocks", F.coalesce("have", F.lit(0)).alias("have")).where("have < blocks")
    lack = lack.select("source", F.explode(F.sequence("have", F.col("blocks") - 1)).alias("k"), F.lit(total).alias("slot"))
    return ranked.where("k < blocks").select("source", "k", "slot").unionByName(lack.select("source", "k", F.col("slot").cast("long")))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Documents and pieces of the mix.

    (row, doc_id, source, size, source_size, target) of every document, and
    (slot, source, k, row, first_word, n_words): the piece of a document that a block in a slot holds.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long")
    sized = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("h")))
    targets = scratch.keep(mixing_targets(sized, weights, share, most))
    full = sized.where("size > 0").withColumn("bucket", F.shiftrightunsigned("h", 52))
    buckets = full.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n"))
    placed = full.withColumn("end", F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)))
    placed = meet(placed, buckets.drop("n"), ["source", "bucket"]).select("row", "source", "size", (F.col("end") + F.col("before") - F.col("size")).alias("start"))
    placed = meet(placed, targets, ["source"]).select("row", "source", "size", "start", "source_size", F.round("target").cast("long").alias("take"))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)))
    spans = placed.withColumn("round", rounds).withColumn("lo", F.col("start") + F.col("round") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "take")).where("lo < hi")
    pieces = spans.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    a, b = F.greatest("lo", F.col("k") * block), F.least("hi", (F.col("k") + 1) * block)
    pieces = pieces.select("row", "source", "k", (a - F.col("lo")).alias("first_word"), (b - a).alias("n_words"))
    slots = scratch.keep(schedule(targets, block))
    mixed = meet(pieces, slots, ["source", "k"]).select("slot", "source", "k", "row", "first_word", "n_words")
    return meet(sized, targets, ["source"]).select("row", "doc_id", "source", "size", "source_size", "target"), mixed


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    all_docs, pieces = mix(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return all_docs.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
