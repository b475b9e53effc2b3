"""Further graph operators: neighbourhoods, order, strong components, spanning trees, matrices, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.guards import ratio
from sparkwright.operators.graph import breadth_first, connected_components, cut, undirected


def k_hop(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, hops): all nodes within ``hops`` directed edges of each stated source, the source included."""
    seen = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")))
    front = seen
    for step in range(1, hops + 1):
        ahead = edges.join(front.select("source", F.col("node").alias("src")), "src").select("source", F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(step).alias("hops")))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    return seen


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the most edges on a path to the node; nodes in rising level are in topological order. A node on or
    behind a cycle has a null level. Each round takes the nodes whose predecessors all have a level."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done, level = None, 0
    open_nodes = nodes
    while True:
        ready = cut(open_nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        done = ready if done is None else cut(done.union(ready))
        open_nodes = cut(open_nodes.join(ready, "node", "left_anti"))
        left = cut(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    rest = open_nodes.select("node", F.lit(None).cast("int").alias("level"))
    return rest if done is None else done.union(rest)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node on a common cycle with the node, or the node itself.

    Nodes without incoming or outgoing edges are components of their own and go first. Then each node learns the
    smallest node that reaches it; from that one, backwards inside its colour, its component is found. Both repeat on
    what is left."""
    left = cut(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    found = None

    def add(part: DataFrame) -> None:
        nonlocal found
        found = part if found is None else cut(found.union(part))

    while not nodes.isEmpty():
        while True:  # trim
            both = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node")
            single = cut(nodes.join(both, "node", "left_anti"))
            if single.isEmpty():
                break
            add(single.select("node", F.col("node").alias("component")))
            nodes = cut(nodes.join(single, "node", "left_anti"))
            left = cut(left.join(single.withColumnRenamed("node", "src"), "src", "left_anti").join(single.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        if nodes.isEmpty():
            break
        colour = nodes.withColumn("colour", F.col("node"))
        while True:
            low = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
            new = cut(colour.join(low, "node", "left").select("node", F.least("colour", F.coalesce("low", "colour")).alias("colour"), (F.col("low") < F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if new.where("moved").isEmpty():
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = breadth_first(back, colour.where("node = colour").select("node")).select("node")
        part = cut(reached.join(colour, "node").select("node", F.col("colour").alias("component")))
        add(part)
        nodes = cut(nodes.join(part, "node", "left_anti"))
        gone = part.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found if found is not None else nodes.select("node", F.col("node").alias("component"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of the minimum spanning forest of undirected weighted edges (Boruvka): each component takes its
    lightest edge to another one, ties to the smaller ends; the forest doubles its components' sizes every round."""
    both = F.array_sort(F.array("src", "dst"))
    e = cut(edges.where("src <> dst").select(both[0].alias("src"), both[1].alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    left = e.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b"))
    tree = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a", "b")).alias("c"), F.struct("weight", "src", "dst").alias("edge"))
        chosen = cut(ends.groupBy("c").agg(F.min("edge").alias("edge")).select("edge.*").distinct())
        tree = chosen if tree is None else cut(tree.union(chosen))
        labels = connected_components(tree.select("src", "dst")).select("node", "component")
        at = left.select("src", "dst", "weight").join(labels.select(F.col("node").alias("src"), F.col("component").alias("a")), "src", "left").join(labels.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst", "left")
        left = cut(at.select("src", "dst", "weight", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")).where("a <> b"))
    return (tree if tree is not None else e).select("src", "dst", "weight")


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, value) of the Laplacian of the undirected graph, zeros left out: degrees on the diagonal, -1 for an edge."""
    both = undirected(edges).where("src <> dst")
    return both.groupBy("src").agg(F.count("*").cast("double").alias("value")).select(F.col("src").alias("i"), F.col("src").alias("j"), "value").unionAll(both.select("src", "dst", F.lit(-1.0)))


def incidence(edges: DataFrame) -> DataFrame:
    """(node, src, dst, value): -1 where an edge leaves, 1 where it enters."""
    e = edges.select("src", "dst").distinct()
    return e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(-1).alias("value")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("value")))).alias("p"), "src", "dst").select("p.node", "src", "dst", "p.value")


def edge_homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(edges, same, share) of edges whose ends have one label; ``labels`` is (node, label)."""
    at = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"))
    s = edges.join(at("src"), "src").join(at("dst"), "dst").agg(F.count("*").alias("edges"), F.count_if(F.col("l_src") == F.col("l_dst")).alias("same"))
    return s.select("edges", "same", ratio(F.col("same").cast("double"), F.col("edges")).alias("share"))


def conductance(edges: DataFrame, inside: Column) -> DataFrame:
    """(cut, volume, other, conductance) of the nodes for which ``inside`` (a condition on ``node``) holds."""
    both = undirected(edges).where("src <> dst")
    flagged = both.select(F.col("src").alias("node"), "dst").withColumn("a", inside).select("a", F.col("dst").alias("node")).withColumn("b", inside)
    s = flagged.agg(F.count_if(F.col("a") & ~F.col("b")).alias("cut"), F.count_if("a").alias("volume"), F.count_if(~F.col("a")).alias("other"))
    return s.select("cut", "volume", "other", ratio(F.col("cut").cast("double"), F.least("volume", "other")).alias("conductance"))


def two_colouring(edges: DataFrame) -> DataFrame:
    """(component, bipartite): whether the nodes of a component fall into two sides without an edge inside one; sides are
    parities of the distance from the component's smallest node."""
    both = cut(undirected(edges))
    labels = connected_components(edges)
    sides = breadth_first(both, labels.where("node = component").select("node")).select("node", (F.col("hops") % 2).alias("side"))
    at = lambda side: sides.select(F.col("node").alias(side), F.col("side").alias(f"s_{side}"))
    odd = both.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src").alias("node"), (F.col("s_src") == F.col("s_dst")).cast("int").alias("odd"))
    return odd.join(labels, "node").groupBy("component").agg((F.max("odd") == 0).alias("bipartite"))


def all_pairs_shortest(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(src, dst, distance) between all pairs of a small graph by min-plus squaring; the distances are the result, so the
    square of the nodes' number must be storable. With ``hops``, over paths of at most so many edges."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("distance"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    d = cut(e.unionAll(nodes.select("src", F.col("src").alias("dst"), F.lit(0.0))).groupBy("src", "dst").agg(F.min("distance").alias("distance")))

    def joined(first: DataFrame, then: DataFrame) -> DataFrame:
        a = first.select("src", F.col("dst").alias("mid"), F.col("distance").alias("x"))
        b = then.select(F.col("src").alias("mid"), "dst", F.col("distance").alias("y"))
        return cut(a.join(b, "mid").groupBy("src", "dst").agg(F.min(F.col("x") + F.col("y")).alias("distance")))

    done = None
    while hops is None or hops > 0:
        if hops is not None:
            if hops % 2:  # the paths of this power of two of edges
                done = d if done is None else joined(done, d)
            hops //= 2
            if not hops:
                return done
        new = joined(d, d)
        if hops is None and new.exceptAll(d).isEmpty():
            return new
        d = new
    return nodes.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("distance"))
