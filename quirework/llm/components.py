"""Connected components of an edge table, by hooking and pointer jumping.

Each round hooks every node to its smallest neighbour, jumps pointers, and contracts the edges; the edge
table shrinks until it is empty. State is a written table in the shared folder after each round, so lineage
stays short and lost executors cost no more than a round. Nothing is collected: a round sends one count
to the driver. Hot nodes are pre-aggregated (the smallest neighbour is a partial minimum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import cut_lineage


def _jump(parent: DataFrame) -> DataFrame:
    """``node, parent`` with each parent replaced by its own parent, where it has one."""
    over = parent.select(F.col("node").alias("parent"), F.col("parent").alias("__over"))
    return parent.join(over, "parent", "left").select("node", F.coalesce("__over", "parent").alias("parent"))


def _contract(pairs: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between the parents of their ends, without loops and repeats."""
    of = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"__{c}"))
    moved = pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    moved = moved.select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst")).where("src <> dst")
    return moved.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that ``edges (src, dst)`` names; the root is the smallest node.

    Loops name a node without linking it; null ends are ignored; an empty table gives no rows.
    """
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    pairs = cut_lineage(ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct().withColumn("root", F.col("node"))
    pairs = pairs.where("src <> dst")
    while True:
        hooks = pairs.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        parent = cut_lineage(_jump(_jump(hooks)))
        if parent.isEmpty():
            return labels
        moved = parent.select(F.col("node").alias("root"), F.col("parent").alias("__to"))
        labels = cut_lineage(labels.join(moved, "root", "left").select("node", F.coalesce("__to", "root").alias("root")))
        pairs = cut_lineage(_contract(pairs, parent))
