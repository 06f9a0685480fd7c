"""Components of graphs of any diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.storage import Scratch, together


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c): the least node of each node's component, for nodes with an edge.

    Alternating large-star and small-star steps, each an aggregation by node
    over the edges, written to the shared folder; no group is collected. No
    step adds edges, so their number bounds the files that the next one writes.
    """
    state = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
    e = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = scratch.keep(small, now[0])
        before, now = now, state(new)
        scratch.drop(e)
        e = new
        if now == before:  # the same edges: every one leads to its component's least node
            break
    roots = e.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return together(e.unionByName(roots).select(F.col("u").alias("v"), F.col("v").alias("c")), 2 * now[0])
