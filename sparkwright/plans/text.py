"""Queries of the text operators over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.plans.stats import rounded
from sparkwright.registry import REGISTRY
from sparkwright.session import table

WORDS = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


@REGISTRY.add(
    "text_tokens_topk",
    "2.11",
    f"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS.replace("'", "''")}')) AS token FROM documents),
    c AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY token)
    SELECT token, n AS token_count, docs AS doc_count,
           round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + docs)) + 1.0, 6) AS idf
    FROM c ORDER BY n DESC, token LIMIT 50
    """,
)
def tokens_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)).alias("w"))
    # each token as often as it stands, and once more for each document that has it: one exchange of counts by token
    both = words.select(F.explode("w").alias("token"), F.lit(1).alias("n"), F.lit(0).alias("docs")).unionAll(words.select(F.explode(F.array_distinct("w")), F.lit(0), F.lit(1)))
    counts = both.groupBy("token").agg(F.sum("n").alias("token_count"), F.sum("docs").alias("doc_count"))
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("total"))
    top = counts.orderBy(F.desc("token_count"), "token").limit(50)
    return top.crossJoin(F.broadcast(total)).select("token", "token_count", "doc_count", F.round(F.log((1.0 + F.col("total")) / (1.0 + F.col("doc_count"))) + 1.0, 6).alias("idf"))


from sparkwright.operators import text as X  # noqa: E402

_W = WORDS.replace("'", "''")
_LONG = f"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS token FROM documents), bag AS (SELECT doc_id, token, count(*) AS n FROM w GROUP BY 1, 2)"
_LISTS = f"l AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '{_W}') AS t FROM documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@REGISTRY.add("text_bag", "2.11", f"WITH {_LONG} SELECT doc_id, token, n FROM bag")
def text_bag(spark: SparkSession, d: str) -> DataFrame:
    return X.bag_of_words(_docs(spark, d))


@REGISTRY.add(
    "text_vocabulary",
    "2.11",
    f"WITH {_LONG}, c AS (SELECT token, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM bag GROUP BY 1 HAVING sum(n) >= 2) SELECT token, n, docs, CAST(row_number() OVER (ORDER BY n DESC, token) - 1 AS INTEGER) AS id FROM c",
)
def text_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(X.bag_of_words(_docs(spark, d)), min_count=2)


@REGISTRY.add(
    "text_encode",
    "2.3",
    f"""
    WITH {_LONG}, v AS (SELECT token, row_number() OVER (ORDER BY sum(n) DESC, token) AS id FROM bag GROUP BY token QUALIFY id <= 1000),
    p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS token FROM documents)
    SELECT doc_id, count(*) AS length, count(id) AS known, CAST(sum(coalesce(id, 0)) AS BIGINT) AS id_sum FROM p LEFT JOIN v USING (token) GROUP BY 1
    """,
)
def text_encode(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the 1000 most frequent words from 1, unknown words 0; summed up per document."""
    vocab = X.vocabulary(X.bag_of_words(_docs(spark, d)), size=1000).select("token", (F.col("id") + 1).alias("id"))
    coded = X.long_tokens(_docs(spark, d)).join(F.broadcast(vocab), "token", "left")
    return coded.groupBy("doc_id").agg(F.count("*").alias("length"), F.count("id").alias("known"), F.sum(F.coalesce("id", F.lit(0))).alias("id_sum"))


@REGISTRY.add(
    "text_ngrams",
    "2.8",
    f"""
    WITH l AS (SELECT regexp_extract_all(lower(text), '{_W}') AS t FROM conversations),
    g AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS ngram FROM l WHERE len(t) > 1)
    SELECT ngram, count(*) AS n FROM g GROUP BY 1
    """,
)
def text_ngrams(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(X.tokens(F.col("text")).alias("t"))
    return rows.select(F.explode(X.ngrams(F.col("t"), 2)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


@REGISTRY.add(
    "text_character_ngrams",
    "2.8",
    "WITH g AS (SELECT unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3))) AS ngram FROM documents WHERE length(text) >= 3) SELECT ngram, count(*) AS n FROM g GROUP BY 1",
)
def text_character_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.explode(X.character_ngrams(F.col("text"), 3)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


@REGISTRY.add(
    "text_tfidf",
    "2.11",
    f"""
    WITH {_LONG}, df AS (SELECT token, count(*) AS df FROM bag GROUP BY 1), t AS (SELECT doc_id, token, n * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w FROM bag JOIN df USING (token)),
    m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM t GROUP BY 1) SELECT doc_id, token, round(w / norm, 6) AS weight FROM t JOIN m USING (doc_id)
    """,
)
def text_tfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return X.tf_idf(X.bag_of_words(docs), docs.count()).withColumn("weight", F.round("weight", 6))


@REGISTRY.add(
    "text_bm25",
    "2.11",
    f"""
    WITH {_LONG}, len AS (SELECT doc_id, sum(n) AS len FROM bag GROUP BY 1), s AS (SELECT count(*) AS docs, avg(len) AS mean FROM len),
    h AS (SELECT * FROM bag WHERE token IN ('idiot', 'license', 'token')), df AS (SELECT token, count(*) AS df FROM h GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN df USING (token) JOIN len USING (doc_id), s GROUP BY 1
    """,
)
def text_bm25(spark: SparkSession, d: str) -> DataFrame:
    return X.bm25(_docs(spark, d), ["idiot", "license", "token"]).withColumn("score", F.round("score", 6))


_TOP = "v AS (SELECT token FROM bag GROUP BY token ORDER BY sum(n) DESC, token LIMIT 200)"
_PAIRS = f"""
    WITH {_LONG}, {_TOP}, {_LISTS}, p AS (SELECT t, unnest(range(1, len(t))) AS i FROM l WHERE len(t) > 1),
    q AS (SELECT t[i] AS a, unnest(t[i + 1 : i + 4]) AS b FROM p), c AS (SELECT a, b, count(*) AS n FROM q WHERE a IN (FROM v) AND b IN (FROM v) GROUP BY 1, 2)
"""


@REGISTRY.add("text_cooccur", "2.11", f"{_PAIRS} SELECT a, b, n FROM c")
def text_cooccur(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return X.cooccurrence(docs, 4, X.vocabulary(X.bag_of_words(docs), size=200))


@REGISTRY.add(
    "text_pmi",
    "2.11",
    f"""{_PAIRS}, m AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total FROM c), r AS (SELECT *, ln(CAST(n * total AS DOUBLE) / CAST(na * nb AS DOUBLE)) AS pmi FROM m)
    SELECT a, b, n, round(pmi, 5) AS pmi, round(greatest(pmi, 0), 5) AS ppmi, round(pmi / -ln(n / CAST(total AS DOUBLE)), 5) AS npmi FROM r""",
)
def text_pmi(spark: SparkSession, d: str) -> DataFrame:
    got = X.pmi(text_cooccur(spark, d))
    return got.select("a", "b", "n", *(F.round(c, 5).alias(c) for c in ("pmi", "ppmi", "npmi")))


@REGISTRY.add(
    "text_tokeniser_stats",
    "2.11",
    f"WITH {_LISTS} SELECT lang, count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS tokens, round(sum(len(t)) / sum(len(regexp_extract_all(text, '\\S+'))), 6) AS fertility, round(sum(length(text)) / CAST(sum(len(t)) AS DOUBLE), 6) AS chars_per_token FROM l GROUP BY 1",
)
def text_tokeniser_stats(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select("lang", F.length("text").alias("chars"), F.size(X.tokens(F.col("text"))).alias("t"), F.size(X.tokens(F.col("text"), "whitespace", False)).alias("w"))
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("w"), 6).alias("fertility"), F.round(F.sum("chars") / F.sum("t"), 6).alias("chars_per_token"))


@REGISTRY.add("text_stop_words", "2.2", f"WITH {_LONG} SELECT doc_id, CAST(sum(n) AS BIGINT) AS kept FROM bag WHERE token NOT IN ('the', 'of', 'and', 'a', 'in', 'to', 'is') GROUP BY 1")
def text_stop_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(X.tokens(F.col("text")), lambda t: ~t.isin("the", "of", "and", "a", "in", "to", "is"))
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("kept")).where("kept > 0")


@REGISTRY.add(
    "text_shingle_jaccard",
    "2.7",
    f"""
    WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}') AS t FROM benchmark), s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM i WHERE len(t) > 2),
    {_LISTS}, e AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM l WHERE len(t) > 2),
    c AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1), x AS (SELECT doc_id, item_id, count(*) AS shared FROM s JOIN e USING (g) GROUP BY 1, 2)
    SELECT doc_id, item_id, shared, round(shared / (c.n + f.n - shared), 6) AS jaccard, round(shared / c.n, 6) AS contained FROM x JOIN c USING (item_id) JOIN f USING (doc_id)
    """,
)
def text_shingle_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Exact similarity, and share of the item's shingles, of all documents and items that share a three-word shingle."""
    return rounded(X.shingle_overlap(_docs(spark, d), table(spark, d, "benchmark"), 3))


@REGISTRY.add(
    "text_skip_grams",
    "2.8",
    f"""WITH l AS (SELECT regexp_extract_all(lower(text), '{_W}') AS t FROM documents), p AS (SELECT t, unnest(range(1, len(t))) AS i FROM l WHERE len(t) > 1), q AS (SELECT t[i] AS a, unnest(t[i + 1 : i + 3]) AS b FROM p)
    SELECT a || ' ' || b AS pair, count(*) AS n FROM q GROUP BY 1""",
)
def text_skip_grams(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select(X.tokens(F.col("text")).alias("w"))
    return w.select(F.explode(X.skip_grams(F.col("w"), 2)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


@REGISTRY.add(
    "text_edit_distance",
    "2.8",
    "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part",
)
def text_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@REGISTRY.add("text_normalise", "2.8")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.normalise("text").alias("text"), X.strip_accents("text").alias("plain"))


@REGISTRY.add("text_stem", "2.8")
def text_stem(spark: SparkSession, d: str) -> DataFrame:
    """Counts of stems; the distinct words are stemmed, not their occurrences."""
    words = X.bag_of_words(_docs(spark, d)).groupBy("token").agg(F.sum("n").alias("n"))
    return words.groupBy(X.stem("token").alias("stem")).agg(F.sum("n").alias("n"))


@REGISTRY.add("text_sentences", "2.8")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(X.sentences("text")).alias("sentences"))


@REGISTRY.add("text_hashed_features", "2.11")
def text_hashed_features(spark: SparkSession, d: str) -> DataFrame:
    return X.hashed_features(X.bag_of_words(_docs(spark, d)), 1024)
