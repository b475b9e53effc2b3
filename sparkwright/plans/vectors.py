"""Queries of similarity search over ``embeddings`` and of graphs over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import graph as G
from sparkwright.operators import similarity as V
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table
from sparkwright.storage import stored

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_D = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))",
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
}


def _nearest_sql(metric: str, where: str = "a.vec_id % 20 = 0", k: int = 5) -> str:
    return f"""WITH {_E}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour, {_D[metric]} AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour) AS rank FROM p)"""


for _metric in _D:

    def _plan(spark: SparkSession, d: str, metric: str = _metric) -> DataFrame:
        e = table(spark, d, "embeddings")
        return rounded(V.nearest(e, e.where("vec_id % 20 = 0"), 5, metric))

    REGISTRY.add(f"knn_{_metric}", "2.12", _nearest_sql(_metric) + "SELECT query_id, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")(_plan)


@REGISTRY.add(
    "knn_vote",
    "2.17",
    _nearest_sql("euclidean", "a.vec_id % 20 = 0") + ", c AS (SELECT query_id, label, count(*) AS votes FROM r JOIN e ON e.vec_id = r.neighbour WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS i FROM c) SELECT query_id, label, votes FROM w WHERE i = 1",
)
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.vote(V.nearest(e, e.where("vec_id % 20 = 0"), 5), e, "vec_id", "label")


@REGISTRY.add(
    "anomaly_lof",
    "2.17",
    _nearest_sql("euclidean", "true") + """, n AS (SELECT * FROM r WHERE rank <= 5), far AS (SELECT query_id, distance AS kd FROM n WHERE rank = 5),
    l AS (SELECT n.query_id, 1 / avg(greatest(distance, kd)) AS lrd FROM n JOIN far ON far.query_id = n.neighbour GROUP BY 1) SELECT n.query_id, round(avg(o.lrd) / any_value(s.lrd), 5) AS lof FROM n JOIN l o ON o.query_id = n.neighbour JOIN l s ON s.query_id = n.query_id GROUP BY 1""",
)
def anomaly_lof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.local_outlier_factor(stored(V.nearest(e, e, 5), "neighbours"), 5).withColumn("lof", F.round("lof", 5))


_MINKOWSKI = "power(list_sum(list_transform(list_zip(a.v, b.v), lambda p: power(abs(p[1] - p[2]), 3))), 1.0 / 3)"
_D["minkowski"], _D["angular"] = _MINKOWSKI, "acos(least(greatest(list_cosine_similarity(a.v, b.v), -1), 1)) / pi()"


@REGISTRY.add("knn_minkowski", "2.12", _nearest_sql("minkowski") + "SELECT query_id, neighbour, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_minkowski(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(V.nearest(e, e.where("vec_id % 20 = 0"), 5, "minkowski", p=3.0), 5)


@REGISTRY.add("knn_angular", "2.12", _nearest_sql("angular") + "SELECT query_id, neighbour, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_angular(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(V.nearest(e, e.where("vec_id % 20 = 0"), 5, "angular"), 5)


@REGISTRY.add("knn_graph_directed", "2.3", _nearest_sql("euclidean", "true") + "SELECT query_id AS src, neighbour AS dst, round(distance, 6) AS distance FROM r WHERE rank <= 5")
def knn_graph_directed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(V.neighbour_graph(V.nearest(e, e, 5)))


@REGISTRY.add("knn_graph_mutual", "2.3", _nearest_sql("euclidean", "true") + ", n AS (SELECT query_id, neighbour, distance FROM r WHERE rank <= 5) SELECT x.query_id AS src, x.neighbour AS dst, round(x.distance, 6) AS distance FROM n x JOIN n y ON x.query_id = y.neighbour AND x.neighbour = y.query_id WHERE x.query_id < x.neighbour")
def knn_graph_mutual(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(V.neighbour_graph(stored(V.nearest(e, e, 5), "neighbours"), mutual=True))


@REGISTRY.add("knn_tomek_links", "2.3", _nearest_sql("euclidean", "true") + ", n AS (SELECT query_id, neighbour FROM r WHERE rank = 1) SELECT x.query_id AS a, x.neighbour AS b FROM n x JOIN n y ON x.query_id = y.neighbour AND x.neighbour = y.query_id JOIN e ea ON ea.vec_id = x.query_id JOIN e eb ON eb.vec_id = x.neighbour WHERE x.query_id < x.neighbour AND ea.label <> eb.label")
def knn_tomek_links(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.tomek_links(stored(V.nearest(e, e, 1), "neighbours"), e, "vec_id", "label")


@REGISTRY.add("knn_lsh_recall", "2.12")
def knn_lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0")
    dim = len(e.first()["embedding"])
    return V.recall(V.lsh_nearest(e, q, 5, dim, bits=4, tables=30), V.nearest(e, q, 5, "cosine"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers to parts (shifted to ids of their own) of large sales at a high discount: a sparse bipartite graph."""
    li = table(spark, d, "lineitem").where(_LARGE)
    return li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).distinct()


_LARGE = "l_quantity >= 48 AND l_discount >= 0.09"
_G = "g AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.09), u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"


@REGISTRY.add("graph_degree", "2.15", f"WITH {_G} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g) GROUP BY 1")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


@REGISTRY.add("graph_bfs", "2.15", f"WITH RECURSIVE {_G}, b(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, hops + 1 FROM b JOIN u ON src = node WHERE hops < 6) SELECT node, min(hops) AS hops FROM b GROUP BY 1")
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(1,)], "node long")
    return G.breadth_first(G.undirected(_edges(spark, d)), start, 6)


@REGISTRY.add("graph_components", "2.15", f"WITH RECURSIVE {_G}, c(node, component) AS (SELECT src, src FROM u UNION SELECT dst, component FROM c JOIN u ON src = node) SELECT node, min(component) AS component FROM c GROUP BY 1")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(_edges(spark, d))


@REGISTRY.add(
    "graph_sssp",
    "2.15",
    "WITH RECURSIVE g AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, min(l_quantity) AS w FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.09 GROUP BY 1, 2), u AS (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g), b(node, distance, hops) AS (SELECT 1::BIGINT, 0::DOUBLE, 0 UNION SELECT dst, distance + w, hops + 1 FROM b JOIN u ON src = node WHERE hops < 4) SELECT node, min(distance) AS distance FROM b GROUP BY 1",
)
def graph_sssp(spark: SparkSession, d: str) -> DataFrame:
    """Shortest distances over at most four edges from supplier 1."""
    li = table(spark, d, "lineitem").where(_LARGE)
    e = li.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg(F.min("l_quantity").alias("weight"))
    both = e.union(e.select("dst", "src", "weight"))
    return G.shortest_paths(both, 1, 4)


_LP = "SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS i FROM u JOIN {0} ON {0}.node = u.dst GROUP BY src, label) WHERE i = 1"


@REGISTRY.add("graph_label_propagation", "2.15", f"WITH {_G}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM u), l1 AS ({_LP.format('l0')}), l2 AS ({_LP.format('l1')}), l3 AS ({_LP.format('l2')}) SELECT node, label FROM l3")
def graph_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(_edges(spark, d), 3)


@REGISTRY.add(
    "graph_adamic_adar",
    "2.15",
    f"WITH {_G}, d AS (SELECT src AS dst, count(*) AS d FROM u GROUP BY 1 HAVING count(*) > 1) SELECT a.src AS a, b.src AS b, count(*) AS shared, round(sum(1 / ln(d)), 6) AS score FROM u a JOIN d USING (dst) JOIN u b ON b.dst = a.dst AND b.src <> a.src GROUP BY 1, 2",
)
def graph_adamic_adar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.adamic_adar(_edges(spark, d)))


@REGISTRY.add(
    "graph_triangles",
    "2.15",
    """WITH x AS (SELECT o_custkey + 2000000 AS c, l_suppkey AS s, l_partkey + 1000000 AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 48 AND l_discount >= 0.09), g AS (SELECT c AS src, s AS dst FROM x UNION SELECT s, p FROM x UNION SELECT p, c FROM x), u AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst), d AS (SELECT src AS node, count(*) AS d FROM u GROUP BY 1),
    t AS (SELECT a.src AS node, count(*) AS t FROM u a JOIN u b ON b.src = a.src AND a.dst < b.dst JOIN u c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1) SELECT node, coalesce(t, 0) AS triangles, round(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN t USING (node)""",
)
def graph_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Customers, suppliers and parts that meet in a large sale."""
    x = table(spark, d, "lineitem").where(_LARGE).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    c, s, p = F.col("o_custkey") + 2_000_000, F.col("l_suppkey"), F.col("l_partkey") + 1_000_000
    pairs = F.array(*(F.struct(a.alias("src"), b.alias("dst")) for a, b in ((c, s), (s, p), (p, c))))
    e = x.select(F.inline(pairs)).distinct()
    return rounded(G.triangles(e))


@REGISTRY.add("graph_weisfeiler_lehman", "2.15")
def graph_weisfeiler_lehman(spark: SparkSession, d: str) -> DataFrame:
    return G.weisfeiler_lehman(_edges(spark, d), 2).groupBy("colour").agg(F.count("*").alias("nodes"))
