"""Self-references: closure, subtree, depth, inherited values, Euler intervals.

The closure doubles its reach each round (paths of 2^k steps join paths of 2^k
steps), so a tree of depth d takes log d joins. Cycles are told apart: a node
that reaches itself is reported and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 20


class CycleError(ValueError):
    pass


def closure(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(node, ancestor, depth): every node with each of its ancestors and itself (depth 0)."""
    up = nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    reach = nodes.select(F.col(key).alias("node"), F.col(key).alias("ancestor"), F.lit(0).alias("depth"))
    for _ in range(MAX_ROUNDS):
        if up.where("node = ancestor").limit(1).count():
            raise CycleError("a node is its own ancestor")
        step = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        reach = reach.unionByName(reach.join(step, "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")))
        far = up.join(step, "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).persist()
        if not far.limit(1).count():
            return reach
        up = far
    raise CycleError(f"deeper than 2^{MAX_ROUNDS}")


def subtree(nodes: DataFrame, key: str, parent: str, root) -> DataFrame:
    """The ids below a node, itself included, with their depth below it."""
    return closure(nodes, key, parent).where(F.col("ancestor") == F.lit(root)).select(F.col("node").alias(key), "depth")


def roll_up(nodes: DataFrame, facts: DataFrame, key: str, parent: str, ref: str, value: str) -> DataFrame:
    """Sums of facts over each node's subtree, 0 where it has none."""
    below = closure(nodes, key, parent)
    sums = facts.groupBy(F.col(ref).alias("node")).agg(F.sum(value).alias("v"))
    return below.join(sums, "node", "left").groupBy(F.col("ancestor").alias(key)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.count("*").alias("nodes"))


def inherited(nodes: DataFrame, key: str, parent: str, attribute: str) -> DataFrame:
    """Each node's value of an attribute, from the nearest ancestor that has one."""
    values = nodes.where(F.col(attribute).isNotNull()).select(F.col(key).alias("ancestor"), F.col(attribute).alias("value"))
    near = closure(nodes, key, parent).join(values, "ancestor").groupBy("node").agg(F.min_by("value", "depth").alias(attribute))
    return nodes.select(F.col(key).alias("node")).join(near, "node", "left").withColumnRenamed("node", key)


def euler(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, depth, tin, tout) with children in the order of their keys: x lies below y when y.tin <= x.tin <= y.tout.

    A node's entry is the number of nodes before it in that order: its
    ancestors and the subtrees of earlier siblings of each node on its path.
    """
    from pyspark.sql import Window as W

    c = closure(nodes, key, parent)
    sizes = c.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"))
    own = nodes.select(F.col(key).alias("node"), F.col(parent).alias("up")).join(sizes, "node")
    before = own.withColumn("skip", F.coalesce(F.sum("size").over(W.partitionBy("up").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    path = c.join(before.select(F.col("node").alias("ancestor"), "skip"), "ancestor").groupBy("node").agg(F.sum("skip").alias("skip"), F.max("depth").alias("depth"))
    return path.join(sizes, "node").select(F.col("node").alias(key), "depth", (F.col("skip") + F.col("depth")).alias("tin"), (F.col("skip") + F.col("depth") + F.col("size") - 1).alias("tout"))


def interval_join(points: DataFrame, x: str, spans: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Points within closed intervals, by an equi-join on cells of ``width``; a span is listed once a cell it touches."""
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("__cell", F.floor(F.col(x) / width)).join(cells, "__cell").where((F.col(x) >= F.col(lo)) & (F.col(x) <= F.col(hi))).drop("__cell")


def adjacency(edges: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Sorted neighbours by source and by target."""
    forward = edges.groupBy(F.col(source).alias("node")).agg(F.array_sort(F.collect_set(target)).alias("neighbours"))
    back = edges.groupBy(F.col(target).alias("node")).agg(F.array_sort(F.collect_set(source)).alias("neighbours"))
    return forward, back
