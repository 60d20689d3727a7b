"""Trees as tables of nodes and parents: roots, depths, paths and reading order, in as many rounds as the depth has binary digits.

Each round every node takes over the path that the ancestor it points at has found, and points at that one's ancestor (pointer
doubling). A round is one join of the nodes with themselves on keys; there is no loop over levels and nothing on the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered_within
from lodestone.tables import written


def with_trails(nodes: DataFrame, node: str, parent: str, order: str, tree: str | None = None) -> DataFrame:
    """``nodes`` with ``root`` (a node), ``depth`` (0 for roots) and ``trail``, the ``order`` values from the root down to the node.

    A node without a parent, or whose parent isn't a node, is a root. Nodes that no root reaches, those on a cycle and below one, are left
    out. ``tree``: a column of trees that have their nodes for themselves. ``node`` is unique in its tree; nodes with a null key are left out.
    """
    key = F.col(tree) if tree else F.lit(0)
    rows = nodes.where(F.col(node).isNotNull())
    pairs = rows.select(key.alias("tree"), F.col(node).alias("node"), F.col(parent).alias("up"), F.col(order).alias("order"))
    known = pairs.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    there = (F.col("tree").eqNullSafe(F.col("_tree"))) & (F.col("up") == F.col("_node"))
    steps = pairs.join(known, there, "left").select("tree", "node", F.col("_node").alias("up"), F.when(F.col("_node").isNull(), F.col("node")).alias("root"), F.array("order").alias("trail"))
    steps = written(steps, "trails")
    left, before = steps.where("root is null").count(), None
    # A rooted node has rooted nodes of every depth above it, so a round that roots none is the last: what is left is on a cycle or below one.
    while left and left != before:
        above = steps.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("trail").alias("_trail"))
        met = steps.where("root is null").join(above, there).select("tree", "node", F.col("_up").alias("up"), F.col("_root").alias("root"), F.concat("_trail", "trail").alias("trail"))
        steps = written(steps.where("root is not null").unionByName(met), "trails")
        left, before = steps.where("root is null").count(), left
    found = steps.where("root is not null").select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "root", "trail", (F.size("trail") - 1).alias("depth"))
    return rows.join(found, key.eqNullSafe(F.col("_tree")) & (F.col(node) == F.col("_node"))).drop("_tree", "_node")


def in_reading_order(nodes: DataFrame, node: str, parent: str, order: str, tree: str | None = None, name: str = "reading_ord") -> DataFrame:
    """``with_trails`` and each node's place in its tree's reading order: parents before children, siblings by ``order``."""
    found = with_trails(nodes, node, parent, order, tree)
    if tree is None:
        return numbered_within(found.withColumn("_all", F.lit(0)), ["_all"], ["trail"], name).drop("_all")
    return numbered_within(found, [tree], ["trail"], name)
