"""Edge cases of the operators: empty groups, constants, ties, NaN, published values."""

import math

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import guards
from sparkwright.operators import metrics, sequences, similarity, stats, tables, tests, text


def one(df):
    return df.collect()[0].asDict()


def test_moments_of_a_constant_are_nan(spark):
    r = one(stats.moments(spark.createDataFrame([("a", 2.0), ("a", 2.0)], "g string, x double"), ["g"], "x"))
    assert r["variance"] == 0 and math.isnan(r["skewness"]) and math.isnan(r["kurtosis"])


def test_quantile_methods_on_a_published_sample(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "g string, x double")
    value = lambda m, q: one(stats.quantiles(df, ["g"], "x", [q], m))["value"]
    assert [value(m, 0.25) for m in ("linear", "hazen", "weibull", "inverted", "averaged_inverted", "lower", "higher", "nearest", "midpoint")] == [1.75, 1.5, 1.25, 1, 1.5, 1, 2, 2, 1.5]
    with pytest.raises(ValueError):
        stats.quantiles(df, ["g"], "x", [0.5], "other")


def test_histogram_keeps_empty_bins_and_counts_what_it_drops(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (float("nan"),), (None,)], "x double")
    assert {r.bin: r.n for r in stats.histogram(df, "x", 0.0, 1.0, 2).collect()} == {-1: 2, 0: 1, 1: 1}


def test_guards(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,)], "x double")
    logs = [r[0] for r in df.select(guards.safe_log(F.col("x"))).collect()]
    assert logs[0] == float("-inf") and math.isnan(logs[1]) and logs[2] == 0
    assert math.isnan(one(df.select(guards.ratio(F.col("x"), F.lit(0.0)).alias("r")))["r"])
    assert math.isnan(one(spark.createDataFrame([(1.0,), (float("nan"),)], "x double").agg(guards.nan_min(F.col("x")).alias("m")))["m"])


def test_metrics_with_no_positive_are_nan(spark):
    df = spark.createDataFrame([(0, 0, 0.4), (0, 0, 0.2)], "y int, g int, s double")
    r = one(metrics.binary_rates(df, [], "y", "g"))
    assert math.isnan(r["precision"]) and math.isnan(r["recall"]) and r["accuracy"] == 1
    assert math.isnan(one(metrics.ranking_quality(df, "s", "y"))["auroc"])


def test_auroc_of_ties_is_a_half(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert one(metrics.ranking_quality(df, "s", "y"))["auroc"] == 0.5


def test_kaplan_meier_reaches_zero(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 1)], "g string, t int, e int")
    assert [(r.t, r.at_risk, round(r.survival, 6)) for r in sequences.kaplan_meier(df, ["g"], "t", "e").orderBy("t").collect()] == [(1, 3, 0.666667), (3, 1, 0.0)]


def test_adjusted_p_values_are_the_published_ones(spark):
    df = spark.createDataFrame([("a", p) for p in (0.01, 0.02, 0.03, 0.04)], "g string, p double")
    rows = sequences.adjusted_p(df, ["g"], "p").orderBy("p").collect()
    assert [round(r.bh, 6) for r in rows] == [0.04] * 4
    assert [round(r.holm, 6) for r in rows] == [0.04, 0.06, 0.06, 0.06]
    assert [round(r.hochberg, 6) for r in rows] == [0.04] * 4


def test_special_functions():
    assert tests.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tests.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tests.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert tests.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert tests.kolmogorov_upper(1.3580986) == pytest.approx(0.05, abs=1e-6)


def test_distances(spark):
    r = one(spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>").select(*(f(F.col("a"), F.col("b")).alias(n) for n, f in similarity.DISTANCES.items())))
    assert r["euclidean"] == 5 and r["sqeuclidean"] == 25 and r["manhattan"] == 7 and r["chebyshev"] == 4
    assert r["cosine"] == pytest.approx(1 - 16 / math.sqrt(5 * 52))


def test_text_kernels(spark):
    assert [text.porter_stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "adjustable", "sky")] == ["caress", "poni", "relat", "hop", "happi", "adjust", "sky"]
    assert text.murmur3(b"") == 0 and text.murmur3(b"hello") == 613153351
    df = spark.createDataFrame([("Straße  É",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalise("t")).collect()] == ["strasse é", None]
    assert one(spark.createDataFrame([("One. Two? Three x",)], "t string").select(text.sentences("t").alias("s")))["s"] == ["One.", "Two?", "Three x"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert stats.moments(empty, ["g"], "x").count() == 0
    assert stats.quantiles(empty, ["g"], "x", [0.5]).count() == 0
    assert text.bag_of_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_impute_and_scale(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", 5.0)], "g string, x double")
    assert sorted(r.x for r in tables.impute(df, "x", "mean", ["g"]).collect()) == [1, 1, 1, 5]
    assert {r.x for r in tables.scale(spark.createDataFrame([("a", 3.0), ("b", 3.0)], "g string, x double"), ["x"]).collect()} == {0.0}
