"""Queries of signals, ordered folds and models over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import series as T
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table

_HOURS = "h AS (SELECT event_type, hour(ts) AS i, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2)"


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("i")).agg(F.count("*").cast("double").alias("x"))


@REGISTRY.add(
    "series_periodogram",
    "2.16",
    f"""WITH {_HOURS}, k AS (SELECT CAST(unnest(range(0, 13)) AS INTEGER) AS k), s AS (SELECT event_type, k, sum(x * cos(2 * pi() * ((k * i) % 24) / 24)) AS re, sum(x * sin(2 * pi() * ((k * i) % 24) / 24)) AS im FROM h, k GROUP BY 1, 2)
    SELECT event_type, k, round((re * re + im * im) / 24, 4) AS power FROM s""",
)
def series_periodogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.periodogram(_hours(spark, d), "event_type", "i", "x", 24), 4)


@REGISTRY.add(
    "series_smoothing",
    "2.5",
    f"""WITH RECURSIVE {_HOURS}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i) AS r FROM h), s(event_type, r, i, smooth) AS (SELECT event_type, r, i, x FROM n WHERE r = 1 UNION ALL SELECT n.event_type, n.r, n.i, 0.3::DOUBLE * n.x + 0.7::DOUBLE * smooth FROM s JOIN n ON n.event_type = s.event_type AND n.r = s.r + 1)
    SELECT event_type, CAST(i AS INTEGER) AS i, round(smooth, 6) AS smooth FROM s""",
)
def series_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.exponential_smoothing(_hours(spark, d), ["event_type"], ["i"], "x", 0.3))


@REGISTRY.add(
    "series_envelope",
    "2.5",
    f"WITH {_HOURS} SELECT event_type, CAST(i AS INTEGER) AS i, x, min(x) OVER w AS lower, max(x) OVER w AS upper, quantile_cont(x, 0.5) OVER w AS median FROM h WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
)
def series_envelope(spark: SparkSession, d: str) -> DataFrame:
    return T.median_filter(T.envelope(_hours(spark, d), ["event_type"], ["i"], "x", 2), ["event_type"], ["i"], "x", 2)


@REGISTRY.add("series_dtw", "2.16")
def series_dtw(spark: SparkSession, d: str) -> DataFrame:
    return T.dtw_to(_hours(spark, d), "event_type", "i", "x", [float(v) for v in range(24)], 4)


@REGISTRY.add("series_kalman", "2.9")
def series_kalman(spark: SparkSession, d: str) -> DataFrame:
    return T.kalman_level(_hours(spark, d), "event_type", "i", "x", 1.0, 25.0)


@REGISTRY.add("series_elo", "2.9")
def series_elo(spark: SparkSession, d: str) -> DataFrame:
    """Users as players: an event beats the next one of its type if its value is larger."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_type", "event_id", F.col("user_id").alias("a"), F.lead("user_id").over(w).alias("b"), F.col("value"), F.lead("value").over(w).alias("other"))
    games = e.where("b is not null and a <> b").withColumn("won", F.when(F.col("value") > F.col("other"), 1.0).when(F.col("value") < F.col("other"), 0.0).otherwise(0.5))
    return T.elo(games, "event_type", "event_id", "a", "b", "won")


@REGISTRY.add("series_sax", "2.16")
def series_sax(spark: SparkSession, d: str) -> DataFrame:
    return T.sax(_hours(spark, d), "event_type", "i", "x", 6)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@REGISTRY.add("ml_kmeans", "2.17")
def ml_kmeans(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    v = _vectors(spark, d)
    return KMeans(k=8, seed=1, maxIter=20).fit(v).transform(v).groupBy("prediction").agg(F.count("*").alias("n"))


@REGISTRY.add("ml_gaussian_mixture", "2.17")
def ml_gaussian_mixture(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA

    v = _vectors(spark, d)
    low = PCA(k=3, inputCol="features", outputCol="low").fit(v).transform(v).select("vec_id", F.col("low").alias("features"))
    return GaussianMixture(k=4, seed=1, maxIter=20).fit(low).transform(low).groupBy("prediction").agg(F.count("*").alias("n"))


@REGISTRY.add("ml_pca", "2.17")
def ml_pca(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import PCA

    v = _vectors(spark, d)
    shares = PCA(k=5, inputCol="features", outputCol="low").fit(v).explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "component int, share double")


@REGISTRY.add("ml_als", "2.17")
def ml_als(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.recommendation import ALS

    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = li.groupBy(F.col("o_custkey").cast("int").alias("u"), F.col("l_suppkey").cast("int").alias("i")).agg(F.sum("l_quantity").cast("float").alias("r"))
    m = ALS(userCol="u", itemCol="i", ratingCol="r", implicitPrefs=True, rank=8, maxIter=5, seed=1).fit(r)
    return m.recommendForAllUsers(5).select("u", F.explode("recommendations").alias("rec")).select("u", "rec.i", "rec.rating")


@REGISTRY.add("ml_lda", "2.17")
def ml_lda(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from sparkwright.operators import text as X

    words = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("words"))
    m = CountVectorizer(inputCol="words", outputCol="features", vocabSize=20_000, minDF=2.0).fit(words)
    topics = LDA(k=4, maxIter=5, seed=1).fit(m.transform(words)).describeTopics(5)
    return topics.select("topic", F.explode("termIndices").alias("term"))


@REGISTRY.add("ml_trees", "2.17")
def ml_trees(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy of a random forest on the embeddings' labels."""
    from pyspark.ml.classification import RandomForestClassifier

    v = _vectors(spark, d)
    m = RandomForestClassifier(labelCol="label", numTrees=20, seed=1).fit(v.where("vec_id % 4 <> 0"))
    return m.transform(v.where("vec_id % 4 = 0")).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))


@REGISTRY.add("ml_logistic", "2.17")
def ml_logistic(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression

    v = _vectors(spark, d)
    m = LogisticRegression(labelCol="label", maxIter=30, regParam=0.01).fit(v.where("vec_id % 4 <> 0"))
    return m.transform(v.where("vec_id % 4 = 0")).agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))
