"""Connected components by hooking each node to its smallest neighbour, pointer jumping, and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.workspace import Workspace


def component_labels(ws: Workspace, links: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    Each round takes the smallest smaller neighbour of every node as its parent, jumps pointers to the roots, replaces
    the ends of the links by their roots and keeps those that still differ, until none is left. All tables are written;
    hot parents and hubs stand on the left of inner joins with unique right keys, which adaptive execution splits.
    """
    edges = ws.keep(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), f"{label}-edges")
    labels = ws.keep(edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().select("node", F.col("node").alias("component")), f"{label}-nodes")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        parents = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))
        roots = ws.keep(edges.select(F.col("lo").alias("node")).distinct().join(parents.select("node"), "node", "left_anti").select("node", F.col("node").alias("parent")).unionByName(parents), f"{label}-tree{turn}")
        jump = 0
        while True:
            jump += 1
            up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            above = ws.keep(roots.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), f"{label}-tree{turn}-{jump}")
            roots = above.select("node", "parent")
            if above.where("moved").isEmpty():
                break
        root = roots.select(F.col("node").alias("component"), "parent")
        labels = ws.keep(labels.join(root, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), f"{label}-labels{turn}")
        a = roots.select(F.col("node").alias("lo"), F.col("parent").alias("ra"))
        b = roots.select(F.col("node").alias("hi"), F.col("parent").alias("rb"))
        moved = edges.join(a, "lo").join(b, "hi").where("ra <> rb")
        edges = ws.keep(moved.select(F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi")).distinct(), f"{label}-edges{turn}")
    return labels
