"""Queries of sources, sketches, approximate search, density clusters, subword merges and coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import similarity as V
from sparkwright.operators import sketches as K
from sparkwright.operators import text as X
from sparkwright.plans.stats import rounded
from sparkwright.plans.text import WORDS
from sparkwright.registry import REGISTRY
from sparkwright.session import table
from sparkwright.sources import tables as S
from sparkwright.storage import new_path

_W = WORDS.replace("'", "''")


@REGISTRY.add("src_linspace", "2.1", "SELECT CAST(i AS BIGINT) AS i, round(1 + i * 4 / 10.0::DOUBLE, 6) AS x FROM (SELECT unnest(range(0, 11)) AS i)")
def src_linspace(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.linspace(spark, 1.0, 5.0, 11))


@REGISTRY.add("src_logspace", "2.1", "SELECT CAST(i AS BIGINT) AS i, round(power(10, i / 2.0::DOUBLE), 6) AS x FROM (SELECT unnest(range(0, 7)) AS i)")
def src_logspace(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.logspace(spark, 0.0, 3.0, 7))


@REGISTRY.add("src_meshgrid", "2.1", "SELECT i, j FROM (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(range(0, 4)) AS j)")
def src_meshgrid(spark: SparkSession, d: str) -> DataFrame:
    return S.meshgrid(spark, 6, 4)


for _format in ("csv", "json", "orc"):

    def _plan(spark: SparkSession, d: str, format: str = _format) -> DataFrame:
        """The table through files of this format and back."""
        own = table(spark, d, "customer")
        path = new_path(spark, f"customer-{format}")
        S.write(own, path, format)
        back = S.read(spark, path, format, ", ".join(f"{c} {t}" for c, t in own.dtypes))
        return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_name").alias("last"))

    REGISTRY.add(f"src_{_format}", "2.1", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_name) AS last FROM customer GROUP BY 1")(_plan)


@REGISTRY.add("src_blobs", "2.1")
def src_blobs(spark: SparkSession, d: str) -> DataFrame:
    return S.blobs(spark, 300, [[0.0, 0.0], [5.0, 5.0], [0.0, 6.0]], 0.5)


@REGISTRY.add("sample_weighted", "2.6")
def sample_weighted(spark: SparkSession, d: str) -> DataFrame:
    return S.weighted_sample(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 100).select("o_orderkey", "o_totalprice")


@REGISTRY.add("text_minhash_estimate", "2.11")
def text_minhash_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated and exact similarity of the benchmark items' distinct words, for items that share a band."""
    sh = F.array_distinct(X.tokens(F.col("text")))
    sig = table(spark, d, "benchmark").select("item_id", sh.alias("s")).withColumn("sig", K.minhash(F.col("s"), 64))
    pairs = K.lsh_candidates(sig, "item_id", "sig", 32, 2)
    a = sig.select(F.col("item_id").alias("a"), F.col("s").alias("sa"), F.col("sig").alias("ga"))
    b = sig.select(F.col("item_id").alias("b"), F.col("s").alias("sb"), F.col("sig").alias("gb"))
    exact = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "shared", K.signature_similarity(F.col("ga"), F.col("gb")).alias("estimate"), exact.alias("exact"))


@REGISTRY.add("knn_ivf_recall", "2.12")
def knn_ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0")
    return V.recall(K.inverted_file(e, q, 5, 8, 6), V.nearest(e, q, 5))


@REGISTRY.add(
    "cluster_dbscan",
    "2.17",
    """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02::DOUBLE * 0.02::DOUBLE),
    c AS (SELECT id FROM n GROUP BY 1 HAVING count(*) >= 5), e AS (SELECT n.id, n.other FROM n JOIN c USING (id) JOIN c d ON d.id = n.other), r(id, cluster) AS (SELECT id, id FROM c UNION SELECT e.other, r.cluster FROM r JOIN e ON e.id = r.id),
    k AS (SELECT id, min(cluster) AS cluster FROM r GROUP BY 1), b AS (SELECT n.id, min_by(k.cluster, n.other) AS cluster FROM n JOIN k ON k.id = n.other WHERE n.id NOT IN (SELECT id FROM c) GROUP BY 1)
    SELECT p.id, coalesce(k.cluster, b.cluster, -1) AS cluster FROM p LEFT JOIN k USING (id) LEFT JOIN b ON b.id = p.id""",
)
def cluster_dbscan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return K.density_clusters(e, "vec_id", ["x", "y"], 0.02, 5)


@REGISTRY.add("text_bpe_merges", "2.11")
def text_bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return K.learn_merges(words, 12)


@REGISTRY.add(
    "text_coherence",
    "2.11",
    f"""WITH d AS (SELECT regexp_extract_all(lower(text), '{_W}') AS t FROM documents), w AS (SELECT unnest(['the', 'of', 'idiot', 'la']) AS w, unnest([1, 2, 3, 4]) AS i), n AS (SELECT w, i, (SELECT count(*) FROM d WHERE list_contains(t, w)) AS n FROM w), s AS (SELECT CAST(count(*) AS DOUBLE) AS s FROM d),
    p AS (SELECT a.n AS na, b.n AS nb, (SELECT count(*) FROM d WHERE list_contains(t, a.w) AND list_contains(t, b.w)) AS ab FROM n a JOIN n b ON a.i > b.i)
    SELECT round(avg(ln((ab / s + 1e-12) / (na / s * (nb / s))) / -ln(ab / s + 1e-12)), 6) AS npmi, round(avg(ln((ab + 1.0) / nb)), 6) AS umass FROM p, s""",
)
def text_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.coherence(table(spark, d, "documents"), ["the", "of", "idiot", "la"], "doc_id", X.tokens(F.col("text"))))
