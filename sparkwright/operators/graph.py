"""Graph operators over (src, dst[, weight]) edges, as joins iterated to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.storage import sized, stored


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table in the shared folder, which survives lost executors."""
    return stored(df, "graph")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In-, out- and total degree of every node of an edge."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return both.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))


def breadth_first(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, hops) of the nodes that directed edges reach from the sources, within ``rounds`` hops if given."""
    seen = cut(sources.select("node", F.lit(0).alias("hops")))
    front, step = seen, 0
    while rounds is None or step < rounds:
        step += 1
        ahead = edges.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(seen, "node", "left_anti").select("node", F.lit(step).alias("hops")))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected paths reach.

    Each round hooks every node to its smallest neighbour below it, jumps pointers to the roots, and replaces the ends
    of the edges by their roots, until no edge joins two components; so rounds and edges fall geometrically.
    """
    left = cut(edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct())
    labels = cut(left.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("component", F.col("node")))
    left = left.where("lo < hi")
    while not left.isEmpty():
        parents = left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
        tops = left.select(F.col("lo").alias("node")).distinct().join(parents, "node", "left_anti").select("node", F.col("node").alias("up"))
        roots = cut(parents.unionByName(tops))
        while True:
            above = roots.select(F.col("node").alias("up"), F.col("up").alias("far"))
            jumped = cut(roots.join(above, "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
            roots = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        labels = cut(labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        ends = left.join(roots.select(F.col("node").alias("lo"), F.col("up").alias("a")), "lo").join(roots.select(F.col("node").alias("hi"), F.col("up").alias("b")), "hi")
        left = cut(ends.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    return labels


def shortest_paths(edges: DataFrame, source: int, rounds: int | None = None) -> DataFrame:
    """(node, distance) by relaxing edges (Bellman-Ford) until none improves, or over at most ``rounds`` edges. Only
    nodes that improved are relaxed again. A negative cycle raises an error."""
    spark = edges.sparkSession
    best = cut(spark.createDataFrame([(source, 0.0)], "node long, distance double"))
    front, step = best, 0
    nodes = edges.select(F.explode(F.array("src", "dst"))).distinct().count() if rounds is None else None
    while rounds is None or step < rounds:
        step += 1
        if nodes is not None and step > nodes + 1:
            raise ValueError("the edges have a negative cycle")
        ahead = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        front = cut(ahead.join(best.withColumnRenamed("distance", "old"), "node", "left").where("old is null or distance < old").select("node", "distance"))
        if front.isEmpty():
            break
        best = cut(best.union(front).groupBy("node").agg(F.min("distance").alias("distance")))
    return best


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after fixed rounds; each node takes the most frequent label of its neighbours, ties to the smallest."""
    both = cut(undirected(edges))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select("node", (-F.col("b.l")).alias("label")))
    return labels


def weisfeiler_lehman(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, colour) after fixed refinements: a colour hashes the node's and the sorted colours of its neighbours."""
    both = cut(undirected(edges))
    colours = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("colour"))
    for _ in range(rounds):
        around = both.join(colours.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.xxhash64(F.sort_array(F.collect_list("colour"))).alias("around"))
        colours = cut(colours.join(around, "node").select("node", F.xxhash64("colour", "around").alias("colour")))
    return colours


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles and the local clustering coefficient of every node; pairs are opened at the end of smaller degree."""
    both = undirected(edges).where("src <> dst")
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    ranked = both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    up = cut(ranked.where("d < e or (d = e and src < dst)").select("src", "dst"))
    wedges = up.alias("a").join(up.alias("b"), F.expr("a.src = b.src and a.dst < b.dst")).select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    closed = wedges.join(both.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    count = closed.select(F.explode(F.array("x", "y", "z")).alias("src")).groupBy("src").agg(F.count("*").alias("t"))
    return deg.join(count, "src", "left").select(F.col("src").alias("node"), F.coalesce("t", F.lit(0)).alias("triangles"), F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def adamic_adar(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, score) of the pairs (with a in ``nodes``, if given) that share neighbours: sum of 1 / ln(degree)."""
    both = undirected(edges)
    deg = both.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("d")).where("d > 1")
    left = (both if nodes is None else both.join(sized(nodes.withColumnRenamed("node", "src")), "src")).select(F.col("src").alias("a"), "dst")
    pairs = left.join(deg, "dst").join(both.select(F.col("src").alias("b"), "dst"), "dst").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(1 / F.log("d")).alias("score"))
