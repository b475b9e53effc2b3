"""MinHash signatures and bands, inverted files and product quantisation, density clusters, subword merges, coherence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators.similarity import doubles, squared_euclidean


def minhash(shingles: Column, hashes: int) -> Column:
    """The minima of ``hashes`` keyed 64-bit hashes over an array of shingles; null for an empty array."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(k))))

    return F.when(F.size(shingles) > 0, F.array(*map(least, range(hashes))))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal minima: an unbiased estimate of the Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def bands(signature: Column, n_bands: int, rows: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.xxhash64(b, F.slice(signature, b * rows + 1, F.lit(rows))))


def lsh_candidates(df: DataFrame, id_col: str, signature: str, n_bands: int, rows: int) -> DataFrame:
    """(a, b, shared): pairs that agree in all rows of at least one band, with the number of bands shared."""
    keyed = df.where(F.col(signature).isNotNull()).select(id_col, F.posexplode(bands(F.col(signature), n_bands, rows)).alias("band", "key"))
    a = keyed.select(F.col(id_col).alias("a"), "band", "key")
    b = keyed.select(F.col(id_col).alias("b"), "band", "key")
    return a.join(b, ["band", "key"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def lsh_probability(similarity: float, n_bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** n_bands


def _assign(v: Column, centres: np.ndarray) -> Column:
    """Index of the nearest centre, ties to the smaller index; the centres are literals, so they must be few."""
    c = F.array(*(F.struct(squared_euclidean(v, F.array(*(F.lit(float(x)) for x in row))).alias("d"), F.lit(i).alias("i")) for i, row in enumerate(centres)))
    return F.array_min(c)["i"]


def inverted_file(rows: DataFrame, queries: DataFrame, k: int, cells: int, probes: int, id_col: str = "vec_id", vec: str = "embedding", seed: int = 1) -> DataFrame:
    """Approximate neighbours: rows are dealt to k-means cells, a query looks into its nearest ``probes`` cells (an
    equality join on the cell)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.select(F.col(id_col).alias("neighbour"), doubles(F.col(vec)).alias("v"))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(v.select(array_to_vector("v").alias("f")))
    centres = np.array(model.clusterCenters())
    dealt = v.withColumn("cell", _assign(F.col("v"), centres))
    near = F.array_sort(F.array(*(F.struct(squared_euclidean(F.col("q"), F.array(*(F.lit(float(x)) for x in row))).alias("d"), F.lit(i).alias("i")) for i, row in enumerate(centres))))
    asked = queries.select(F.col(id_col).alias("query_id"), doubles(F.col(vec)).alias("q"))
    asked = asked.select("query_id", "q", F.explode(F.slice(near, 1, probes)).alias("c")).select("query_id", "q", F.col("c.i").alias("cell"))
    d = asked.join(dealt, "cell").where("query_id <> neighbour").select("query_id", "neighbour", F.sqrt(squared_euclidean(F.col("q"), F.col("v"))).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def density_clusters(rows: DataFrame, id_col: str, coordinates: list[str], eps: float, min_points: int) -> DataFrame:
    """DBSCAN: (id, cluster), the smallest core id of the cluster; border points join the smallest core in reach, noise is
    -1. A grid of width eps turns the range join into an equality join on neighbouring cells."""
    from sparkwright.operators.graph import connected_components, cut

    cell = [F.floor(F.col(c) / eps) for c in coordinates]
    p = rows.select(F.col(id_col).alias("id"), *coordinates, *(c.alias(f"g{i}") for i, c in enumerate(cell)))
    spread = p
    for i in range(len(coordinates)):
        spread = spread.withColumn(f"g{i}", F.explode(F.array(*(F.col(f"g{i}") + s for s in (-1, 0, 1)))))
    other = spread.select(F.col("id").alias("other"), *(F.col(c).alias(f"o_{c}") for c in coordinates), *(f"g{i}" for i in range(len(coordinates))))
    distance = sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in coordinates), F.lit(0.0))
    near = cut(p.join(other, [f"g{i}" for i in range(len(coordinates))]).where(distance <= eps * eps).select("id", "other"))
    core = cut(near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("id"))
    core_edges = near.join(core, "id").join(core.withColumnRenamed("id", "other"), "other").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    clusters = connected_components(core_edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    border = near.join(core, "id", "left_anti").join(clusters.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min_by("cluster", "other").alias("cluster"))
    return p.select("id").join(clusters.unionByName(border), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _joined(a: str, b: str):
    """A fold that appends a part, or joins it to the last one if they are a and b."""

    def fold(out: Column, part: Column) -> Column:
        last = F.size(out)
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.lit(a + b)))
        return F.when((F.coalesce(F.get(out, last - 1) == a, F.lit(False))) & (part == b), joined).otherwise(F.array_append(out, part))

    return fold


def learn_merges(words: DataFrame, steps: int) -> DataFrame:
    """(step, left, right, n) of byte-pair merges learnt from a (word, n) table: in each step the most frequent adjacent
    pair, ties to the smaller one. Only the word table is scanned, not the corpus; one row a step reaches the driver."""
    from sparkwright.operators.graph import cut

    spark = words.sparkSession
    state = cut(words.select(F.filter(F.split("word", ""), lambda c: c != "").alias("parts"), "n"))
    merges = []
    for step in range(steps):
        pairs = state.where(F.size("parts") > 1).select("n", F.explode(F.arrays_zip(F.slice("parts", F.lit(1), F.size("parts") - 1).alias("a"), F.slice("parts", F.lit(2), F.size("parts") - 1).alias("b"))).alias("p"))
        best = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").first()
        if best is None:
            break
        merges.append((step, best["a"], best["b"], best["n"]))
        state = state.select(F.aggregate("parts", F.array().cast("array<string>"), _joined(best["a"], best["b"])).alias("parts"), "n")
        if step % 10 == 9:
            state = cut(state)
    return spark.createDataFrame(merges, "step int, left string, right string, n long")


def coherence(docs: DataFrame, words: list[str], id_col: str, tokens: Column) -> DataFrame:
    """NPMI and UMass coherence of one topic's words over whole documents: (npmi, umass) means over the word pairs."""
    held = docs.select(F.array_intersect(tokens, F.array(*map(F.lit, words))).alias("t"))
    total = docs.count()
    has = [F.count_if(F.array_contains("t", w)).alias(f"n{i}") for i, w in enumerate(words)]
    both = [F.count_if(F.array_contains("t", words[i]) & F.array_contains("t", words[j])).alias(f"n{i}_{j}") for i in range(len(words)) for j in range(i)]
    r = held.agg(*has, *both)
    npmi, umass = [], []
    for i in range(len(words)):
        for j in range(i):
            p = F.col(f"n{i}_{j}") / total + 1e-12
            q = F.col(f"n{i}") / total * (F.col(f"n{j}") / total)
            npmi.append(F.log(p / q) / -F.log(p))
            umass.append(F.log((F.col(f"n{i}_{j}") + 1.0) / F.col(f"n{j}")))
    mean = lambda x: sum(x[1:], x[0]) / len(x)
    return r.select(mean(npmi).alias("npmi"), mean(umass).alias("umass"))
