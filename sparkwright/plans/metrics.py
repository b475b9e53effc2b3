"""Queries of evaluation metrics over scores derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import metrics as M
from sparkwright.operators import text as X
from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table

#: Labelled documents with a score from their length: a stand-in for a classifier.
_SCORED = "s AS (SELECT doc_id, source, lang, toxic AS y, quality AS q, least(n_chars, 8000) / 8000.0::DOUBLE AS score, CAST(n_chars >= 2000 AS INTEGER) AS g FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return both.select("doc_id", "source", "lang", F.col("toxic").alias("y"), F.col("quality").alias("q"), (F.least(F.col("n_chars"), F.lit(8000)) / F.lit(8000.0)).alias("score"), (F.col("n_chars") >= 2000).cast("int").alias("g"))


@REGISTRY.add("metric_confusion", "2.14", f"WITH {_SCORED}, c AS (SELECT y, g, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT unnest([0, 1]) AS v) SELECT a.v AS y, b.v AS g, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.y = a.v AND c.g = b.v")
def metric_confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_scored(spark, d), "y", "g")


@REGISTRY.add(
    "metric_binary_rates",
    "2.14",
    f"""WITH {_SCORED}, c AS (SELECT lang, CAST(count(*) FILTER (y = 1 AND g = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND g = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND g = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND g = 0) AS DOUBLE) AS tn FROM s GROUP BY 1),
    e AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS o, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / power(tp + fp + fn + tn, 2) AS x FROM c)
    SELECT lang, round(o, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
           round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((o - x) / (1 - x), 6) AS kappa, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced FROM e""",
)
def metric_binary_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.binary_rates(_scored(spark, d), ["lang"], "y", "g"))


@REGISTRY.add(
    "metric_roc_curve",
    "2.14",
    f"WITH {_SCORED}, p AS (SELECT score AS threshold, count(*) FILTER (y = 1) AS own, count(*) FILTER (y <> 1) AS other FROM s GROUP BY 1) SELECT round(threshold, 6) AS threshold, CAST(sum(own) OVER w AS BIGINT) AS tp, CAST(sum(other) OVER w AS BIGINT) AS fp, CAST(sum(own) OVER () AS BIGINT) AS p, CAST(sum(other) OVER () AS BIGINT) AS n FROM p WINDOW w AS (ORDER BY threshold DESC)",
)
def metric_roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.curve(_scored(spark, d), "score", "y").drop("dt", "df"))


@REGISTRY.add(
    "metric_ranking_quality",
    "2.14",
    f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), n AS (SELECT sum(y) AS p, count(*) - sum(y) AS n FROM s),
    c AS (SELECT score, sum(y) AS own, count(*) - sum(y) AS other FROM s GROUP BY 1), k AS (SELECT own, sum(own) OVER w AS tp, sum(other) OVER w AS fp FROM c WINDOW w AS (ORDER BY score DESC))
    SELECT round((SELECT (sum(r) FILTER (y = 1) - p * (p + 1) / 2) / (p * n) FROM r, n GROUP BY p, n), 6) AS auroc, round(sum(own * tp / (tp + fp)) / max(p), 6) AS average_precision, round(max(2 * tp / (tp + fp + p)), 6) AS best_f1, round(max(tp / p - fp / n), 6) AS ks FROM k, n""",
)
def metric_ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.ranking_quality(_scored(spark, d), "score", "y"))


@REGISTRY.add(
    "metric_probability_scores",
    "2.14",
    f"""WITH {_SCORED}, p AS (SELECT y, score, least(greatest(score, 1e-15), 1 - 1e-15) AS c, least(floor(score * 10), 9) AS bin FROM s), b AS (SELECT bin, count(*) AS n, avg(score) AS m, avg(y) AS r FROM p GROUP BY 1)
    SELECT round((SELECT avg(-(y * ln(c) + (1 - y) * ln(1 - c))) FROM p), 6) AS log_loss, round((SELECT avg(power(score - y, 2)) FROM p), 6) AS brier, round(sum(n * abs(m - r)) / sum(n), 6) AS ece FROM b""",
)
def metric_probability_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.probability_scores(_scored(spark, d), "score", "y"))


@REGISTRY.add(
    "metric_regression",
    "2.14",
    """WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)
    SELECT l_returnflag, round(avg(e * e), 1) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(avg(e), 4) AS bias, round(avg(abs(e / y)), 6) AS mape, round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(1 - var_pop(e) / var_pop(y), 6) AS explained, round(quantile_cont(abs(e), 0.5), 4) AS median_ae FROM p GROUP BY 1""",
)
def metric_regression(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    r = M.regression(li, ["l_returnflag"], "l_extendedprice", "guess")
    places = {"mse": 1, "rmse": 4, "mae": 4, "bias": 4, "median_ae": 4}
    return r.select(*(F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


_LISTS = "e AS (SELECT user_id, event_id, value AS score, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS gain FROM events)"


@REGISTRY.add(
    "metric_ranked_lists",
    "2.14",
    f"""WITH {_LISTS}, r AS (SELECT user_id, gain, row_number() OVER w AS r, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, event_id) AS i, sum(CAST(gain > 0 AS INTEGER)) OVER w AS hits FROM e WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_id)),
    a AS (SELECT user_id, count(*) FILTER (gain > 0 AND r <= 10) AS h, count(*) FILTER (gain > 0) AS rel, coalesce(sum(hits / r) FILTER (gain > 0 AND r <= 10), 0) AS ap, coalesce(max(1.0 / r) FILTER (gain > 0 AND r <= 10), 0) AS rr,
          coalesce(sum((power(2, gain) - 1) / log2(r + 1.0)) FILTER (r <= 10), 0) AS dcg, sum((power(2, gain) - 1) / log2(i + 1.0)) FILTER (i <= 10) AS best FROM r GROUP BY 1)
    SELECT user_id, round(h / 10.0, 6) AS precision, CASE WHEN rel = 0 THEN 'NaN'::DOUBLE ELSE round(h / rel, 6) END AS recall, round(CASE WHEN rel = 0 THEN 0 ELSE ap / least(rel, 10) END, 6) AS ap, round(rr, 6) AS rr, round(CASE WHEN best = 0 THEN 0 ELSE dcg / best END, 6) AS ndcg FROM a""",
)
def metric_ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("score"), F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0).alias("gain"))
    return rounded(M.ranked_lists(e, "user_id", "event_id", "score", "gain", 10))


@REGISTRY.add(
    "metric_clusterings",
    "2.14",
    """WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem), c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
    s AS (SELECT max(t) AS t, sum(n * (n - 1) / 2) AS joint, sum(n / t * ln(n * t / (na * nb))) AS mi FROM m), ra AS (SELECT a, max(na) AS na, max(n) AS top, max(t) AS t FROM m GROUP BY 1), rb AS (SELECT b, max(nb) AS nb, max(t) AS t FROM m GROUP BY 1),
    ea AS (SELECT sum(na * (na - 1) / 2) AS pa, sum(-na / t * ln(na / t)) AS ha, sum(top) / max(t) AS purity FROM ra), eb AS (SELECT sum(nb * (nb - 1) / 2) AS pb, sum(-nb / t * ln(nb / t)) AS hb FROM rb)
    SELECT round((t * (t - 1) / 2 + 2 * joint - pa - pb) / (t * (t - 1) / 2), 6) AS rand, round((joint - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS adjusted_rand, round(mi, 6) AS mutual_information,
           round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(purity, 6) AS purity FROM s, ea, eb""",
)
def metric_clusterings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.clusterings(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@REGISTRY.add("metric_gini", "2.14", "WITH c AS (SELECT user_id, count(*) AS x FROM events GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM c) SELECT round((2 * sum(r * x) - (max(n) + 1) * sum(x)) / CAST(max(n) * sum(x) AS DOUBLE), 6) AS gini FROM r")
def metric_gini(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.gini(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("x")), "x"))


@REGISTRY.add(
    "metric_fairness",
    "2.14",
    f"""WITH {_SCORED}, r AS (SELECT lang, avg(g) AS rate, avg(g) FILTER (y = 1) AS tpr, avg(g) FILTER (y <> 1) AS fpr FROM s GROUP BY 1)
    SELECT round(max(rate) - min(rate), 6) AS parity_difference, round(min(rate) / max(rate), 6) AS parity_ratio, round(max(tpr) - min(tpr), 6) AS opportunity_difference, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS odds_difference FROM r""",
)
def metric_fairness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.fairness(_scored(spark, d), "lang", "y", "g"))


@REGISTRY.add(
    "metric_off_policy",
    "2.14",
    """WITH p AS (SELECT event_type, count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS logged FROM events GROUP BY 1), b AS (SELECT value AS reward, logged, CASE WHEN e.event_type = 'purchase' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE / (SELECT count(*) - 1 FROM p) END AS target, 50.0::DOUBLE AS model FROM events e JOIN p USING (event_type))
    SELECT round(avg(target / logged * reward), 5) AS ips, round(sum(target / logged * reward) / sum(target / logged), 5) AS snips, round(avg(model + target / logged * (reward - model)), 5) AS dr, round(power(sum(target / logged), 2) / sum(power(target / logged, 2)), 3) AS ess FROM b""",
)
def metric_off_policy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value")
    p = e.groupBy("event_type").agg(F.count("*").alias("c"))
    n = p.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    b = e.join(F.broadcast(p), "event_type").crossJoin(F.broadcast(n))
    b = b.select(F.col("value").alias("reward"), (F.col("c") / F.col("n")).alias("logged"), F.when(F.col("event_type") == "purchase", 0.7).otherwise(0.3 / (F.col("k") - 1)).alias("target"), F.lit(50.0).alias("model"))
    r = M.off_policy(b, "reward", "logged", "target", "model")
    return r.select(*(F.round(c, 3 if c == "ess" else 5).alias(c) for c in r.columns))


@REGISTRY.add(
    "metric_conformal",
    "2.14",
    """WITH e AS (SELECT l_returnflag, round(abs(l_extendedprice - l_quantity * 1500), 2) AS s FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY s) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM e)
    SELECT l_returnflag, s AS quantile FROM r WHERE i = ceil((n + 1) * 0.9::DOUBLE)""",
)
def metric_conformal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_returnflag", F.round(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500), 2).alias("s"))
    return M.conformal_quantile(e, ["l_returnflag"], "s", 0.1)


@REGISTRY.add(
    "metric_cramers_v",
    "2.14",
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c),
    f AS (SELECT ra.a, rb.b, coalesce(n, 0) AS n, na * nb / t AS e, t FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN c ON c.a = ra.a AND c.b = rb.b)
    SELECT round(sum(power(n - e, 2) / e), 5) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS freedom, round(sqrt(sum(power(n - e, 2) / e) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v FROM f""",
)
def metric_cramers_v(spark: SparkSession, d: str) -> DataFrame:
    r = M.cramers_v(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return r.select(F.round("chi2", 5).alias("chi2"), "freedom", F.round("cramers_v", 6).alias("cramers_v"))


@REGISTRY.add(
    "metric_rouge2",
    "2.14",
    r"""WITH c AS (SELECT conv_id * 1000 + turn AS k, regexp_extract_all(lower(text), '\S+') AS t, lead(regexp_extract_all(lower(text), '\S+')) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations),
    p AS (SELECT k, t, u FROM c WHERE u IS NOT NULL),
    r AS (SELECT k, g, count(*) AS r FROM (SELECT k, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM p WHERE len(t) > 1) GROUP BY 1, 2),
    s AS (SELECT k, g, count(*) AS c FROM (SELECT k, unnest(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS g FROM p WHERE len(u) > 1) GROUP BY 1, 2),
    m AS (SELECT k, sum(least(coalesce(r, 0), coalesce(c, 0))) AS matched, coalesce(sum(r), 0) AS a, coalesce(sum(c), 0) AS b FROM r FULL JOIN s USING (k, g) GROUP BY 1)
    SELECT k, CAST(matched AS BIGINT) AS matched, CAST(a AS BIGINT) AS of_reference, CAST(b AS BIGINT) AS of_candidate, round(CASE WHEN b = 0 THEN 0 ELSE matched / b END, 6) AS precision, round(CASE WHEN a = 0 THEN 0 ELSE matched / a END, 6) AS recall, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * matched / (a + b) END, 6) AS f1 FROM m""",
)
def metric_rouge2(spark: SparkSession, d: str) -> DataFrame:
    """Bigram overlap of each turn with the next of its conversation."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    t = X.tokens(F.col("text"), "whitespace")
    p = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), t.alias("t"), F.lead(t).over(Window.partitionBy("conv_id").orderBy("turn")).alias("u")).where("u is not null")
    return rounded(M.ngram_overlap(p, "k", X.ngrams(F.col("t"), 2), X.ngrams(F.col("u"), 2), 2))
