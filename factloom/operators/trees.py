"""Ordered adjacency-list trees: closure, cycle guard, renumbering, moves and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, depth): every node with itself (0) and all above it, however deep; a cycle ends where it closes.

    Pairs double their reach each round (a path of n levels takes log2 n joins), so no
    query runs a level at a time.
    """
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    step = nodes.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    reach, out, span = step, step, 1
    while True:
        right = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        longer = out.join(right, "ancestor").where("node != above").select("node", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        done, out = out, stored(out.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        forget(done)
        span *= 2
        if out.where(F.col("depth") >= span).isEmpty():
            break
        reach = out
    return own.unionByName(out)


def is_descendant(closure: DataFrame, node: object, of: object) -> bool:
    """Whether ``node`` lies under ``of``."""
    return not closure.where((F.col("node") == F.lit(node)) & (F.col("ancestor") == F.lit(of)) & (F.col("depth") > 0)).isEmpty()


def renumber(nodes: DataFrame, *tie: str) -> DataFrame:
    """Siblings numbered 0, 1, ... by order, then ``tie``."""
    w = Window.partitionBy("world", "parent").orderBy("order", *tie)
    return nodes.withColumn("order", (F.row_number().over(w) - 1).cast("int"))


def move(nodes: DataFrame, node: object, parent: object, index: int, *tie: str) -> DataFrame:
    """``nodes`` after one is moved to a place among its new siblings (clamped); both families are renumbered.

    A move under itself or a node below it is refused.
    """
    moved = F.col("node") == F.lit(node)
    if parent is not None:
        if node == parent or is_descendant(ancestors(nodes), parent, node):
            raise ValueError("a node can't move below itself")
    # Without the moved node its siblings are dense; half a place before the index is the new one.
    dense = renumber(nodes.where(~moved), *tie)
    target = nodes.where(moved).withColumns({"parent": F.lit(parent).cast(nodes.schema["parent"].dataType), "order": F.lit(max(0, index) - 0.5)})
    both = dense.withColumn("order", F.col("order").cast("double")).unionByName(target)
    return renumber(both, *tie)


def delete(nodes: DataFrame, node: object, *tie: str) -> DataFrame:
    """``nodes`` after one is deleted: its children take its place in their order."""
    gone = nodes.where(F.col("node") == F.lit(node)).select(F.col("node").alias("parent"), F.col("parent").alias("__to"), F.col("order").alias("__at"))
    met = nodes.where(F.col("node") != F.lit(node)).join(F.broadcast(gone.limit(1)), "parent", "left")
    lifted = F.col("__at").isNotNull()
    w = Window.partitionBy("world", "__new").orderBy(F.coalesce("__at", "order"), F.when(lifted, F.col("order")), *tie)
    out = met.withColumn("__new", F.when(lifted, F.col("__to")).otherwise(F.col("parent"))).withColumn("order", (F.row_number().over(w) - 1).cast("int"))
    return out.withColumn("parent", F.col("__new")).select(*nodes.columns)


def children(nodes: DataFrame) -> DataFrame:
    """(parent, children): each parent's nodes in order."""
    return nodes.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "node"))), lambda x: x["node"]).alias("children"))
