"""Queries of term weights and matrices, subword encoders, answer forms, overlap scores and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import corpus as C
from sparkwright.operators import sketches as K
from sparkwright.operators import text as X
from sparkwright.plans.stats import rounded
from sparkwright.plans.text import _LISTS, _LONG, _W
from sparkwright.registry import REGISTRY
from sparkwright.session import table
from sparkwright.storage import stored


def _bag(spark: SparkSession, d: str) -> DataFrame:
    return X.bag_of_words(table(spark, d, "documents"))


@REGISTRY.add("text_decode", "2.3", f"WITH {_LISTS} SELECT doc_id, md5(array_to_string(t, ' ')) AS digest FROM l WHERE len(t) > 0")
def text_decode(spark: SparkSession, d: str) -> DataFrame:
    """Documents encoded by the whole vocabulary and decoded again."""
    docs = table(spark, d, "documents")
    vocabulary = stored(X.vocabulary(X.bag_of_words(docs)).select("token", F.col("id").alias("code")), "vocabulary")
    coded = X.long_tokens(docs).join(vocabulary, "token").select("doc_id", "pos", "code")
    return C.decode(coded, vocabulary, "doc_id").select("doc_id", F.md5("text").alias("digest"))


_N = "(SELECT CAST(count(*) AS DOUBLE) FROM documents)"
for _code, _tf, _idf, _scaled in (
    ("ltc", "1 + ln(n)", f"ln({_N} / df)", True),
    ("lnc", "1 + ln(n)", "1", True),
    ("ntn", "n", f"ln({_N} / df)", False),
    ("apc", "0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id)", f"greatest(0, ln(greatest(({_N} - df) / df, 1e-300)))", True),
):

    def _plan(spark: SparkSession, d: str, code: str = _code) -> DataFrame:
        return rounded(C.smart_weights(_bag(spark, d), code, table(spark, d, "documents").count()))

    _last = "round(CASE WHEN l > 0 THEN w / l ELSE 0 END, 6)" if _scaled else "round(w, 6)"
    REGISTRY.add(
        f"text_smart_{_code}",
        "2.11",
        f"WITH {_LONG}, df AS (SELECT token, count(*) AS df FROM bag GROUP BY 1), t AS (SELECT doc_id, token, ({_tf}) * ({_idf}) AS w FROM bag JOIN df USING (token)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM t GROUP BY 1) SELECT doc_id, token, {_last} AS weight FROM t JOIN m USING (doc_id)",
    )(_plan)


@REGISTRY.add(
    "text_bm25_plus",
    "2.11",
    f"""WITH {_LONG}, len AS (SELECT doc_id, sum(n) AS len FROM bag GROUP BY 1), s AS (SELECT count(*) AS docs, avg(len) AS mean FROM len), h AS (SELECT * FROM bag WHERE token IN ('the', 'secret', 'idiot')), df AS (SELECT token, count(*) AS df FROM h GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len / mean)) + 1)), 6) AS score FROM h JOIN df USING (token) JOIN len USING (doc_id), s GROUP BY 1""",
)
def text_bm25_plus(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.bm25(table(spark, d, "documents"), ["the", "secret", "idiot"], k1=1.5, delta=1.0))


@REGISTRY.add("text_term_document", "2.11", f"WITH {_LONG}, k AS (SELECT token FROM bag GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.2 * {_N}) SELECT doc_id, token, n FROM bag WHERE token IN (SELECT token FROM k)")
def text_term_document(spark: SparkSession, d: str) -> DataFrame:
    return C.term_document(stored(_bag(spark, d), "bag"), 5, 0.2, table(spark, d, "documents").count()).select("doc_id", "token", "n")


@REGISTRY.add(
    "text_random_indexing",
    "2.11",
    f"""WITH {_LONG}, h AS (SELECT token, n, md5(CAST(doc_id AS VARCHAR) || '-' || CAST(i AS VARCHAR)) AS h FROM bag, (SELECT unnest(range(0, 2)) AS i)), c AS (SELECT token, CAST(CAST(concat('0x', substring(h, 1, 8)) AS BIGINT) % 16 AS INTEGER) AS k, n * CASE WHEN CAST(concat('0x', substring(h, 9, 1)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS v FROM h)
    SELECT token, k, CAST(sum(v) AS BIGINT) AS value FROM c GROUP BY 1, 2""",
)
def text_random_indexing(spark: SparkSession, d: str) -> DataFrame:
    return C.random_index(_bag(spark, d), 16, 2)


@REGISTRY.add("sketch_lsh_curve", "2.11", "SELECT round(s / 20.0, 2)::DOUBLE AS similarity, round(1 - power(1 - power(s / 20.0::DOUBLE, 5), 20), 6) AS probability FROM (SELECT unnest(range(0, 21)) AS s)")
def sketch_lsh_curve(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("id") / 20.0
    return spark.range(21).select(F.round(s, 2).alias("similarity"), F.round(1 - F.pow(1 - F.pow(s, F.lit(5.0)), F.lit(20.0)), 6).alias("probability"))


@REGISTRY.add("text_latent", "2.11")
def text_latent(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of the tf-idf matrix over the 2000 most frequent words (the vocabulary is the operator's limit)."""
    bag = stored(_bag(spark, d), "bag")
    terms = X.vocabulary(bag, size=2000).select("token", "id")
    weights = C.smart_weights(bag, "ltc", table(spark, d, "documents").count())
    singular, _ = C.latent_semantics(weights, terms, 8)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(singular)], "component int, singular double")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return stored(table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")


@REGISTRY.add("text_wordpiece", "2.11")
def text_wordpiece(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all words by a vocabulary of the 1000 most frequent words and all letters, and how often they stand."""
    words = _words(spark, d)
    frequent = {r["word"] for r in words.orderBy(F.desc("n"), "word").limit(1000).collect()}
    letters = {r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()}
    vocabulary = frequent | letters | {"##" + c for c in letters} | {"##" + w for w in frequent if len(w) <= 4}
    coded = C.encode_words(words, lambda w: C.word_piece(w, vocabulary))
    return coded.select(F.explode("pieces").alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))


@REGISTRY.add("text_bpe_encode", "2.11")
def text_bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all words by 12 merges that were learnt from them."""
    words = _words(spark, d)
    ranks = {(r["left"], r["right"]): r["step"] for r in K.learn_merges(words, 12).collect()}
    return C.encode_words(words, lambda w: C.merge_pairs(w, ranks)).select(F.explode("pieces").alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))


@REGISTRY.add("text_unigram", "2.11")
def text_unigram(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest pieces of all words; scores are logarithms of shares of the 1000 most frequent words and the letters."""
    import math

    words = _words(spark, d)
    rows = [(r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(1000).collect()]
    rows += [(r["c"], r["n"]) for r in words.select(F.explode(F.split("word", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n")).collect()]
    total = sum(n for _, n in rows)
    scores = {w: math.log(n / total) for w, n in rows}
    low = min(scores.values()) - 10
    return C.encode_words(words, lambda w: C.likeliest_pieces(w, scores, low)).select(F.explode("pieces").alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))


@REGISTRY.add(
    "text_normalise_answer",
    "2.8",
    r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM conversations",
)
def text_normalise_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(C.normalise_answer(F.col("text"))).alias("digest"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item against the best document that shares a shingle with it."""
    overlap = X.shingle_overlap(table(spark, d, "documents"), table(spark, d, "benchmark"), 3)
    best = overlap.groupBy("item_id").agg(F.max_by("doc_id", F.struct("shared", -F.col("doc_id"))).alias("doc_id"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("candidate"))
    return best.join(docs, "doc_id").join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("reference")), "item_id")


@REGISTRY.add("metric_bleu", "2.14")
def metric_bleu(spark: SparkSession, d: str) -> DataFrame:
    return C.bleu(_answers(spark, d), X.tokens(F.col("reference")), X.tokens(F.col("candidate")))


@REGISTRY.add("metric_chrf", "2.14")
def metric_chrf(spark: SparkSession, d: str) -> DataFrame:
    return C.chr_f(_answers(spark, d), "item_id", F.col("reference"), F.col("candidate"))


@REGISTRY.add("text_huffman", "2.8")
def text_huffman(spark: SparkSession, d: str) -> DataFrame:
    """Code lengths of the characters of all part names."""
    rows = table(spark, d, "part").select(F.explode(F.split("p_name", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()
    counts = {r["c"]: r["n"] for r in rows}
    length = C.huffman_lengths(counts)
    return spark.createDataFrame([(c, counts[c], length[c]) for c in counts], "symbol string, n long, length int")


@REGISTRY.add("text_hamming", "2.8", "SELECT s_suppkey, CASE WHEN length(md5(s_name)) = length(md5(CAST(s_nationkey AS VARCHAR))) THEN (SELECT count(*) FROM (SELECT unnest(range(1, 33)) AS i) WHERE substring(md5(s_name), i, 1) <> substring(md5(CAST(s_nationkey AS VARCHAR)), i, 1)) END AS distance FROM supplier")
def text_hamming(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", C.hamming(F.md5("s_name"), F.md5(F.col("s_nationkey").cast("string"))).alias("distance"))


@REGISTRY.add(
    "text_bench_overlap",
    "2.7",
    f"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}') AS t FROM benchmark), s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i : i + 7], ' '))) AS g FROM i WHERE len(t) > 7), {_LISTS},
    e AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i : i + 7], ' '))) AS g FROM l WHERE len(t) > 7), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1)
    SELECT doc_id, item_id, count(*) AS shared, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS contained FROM s JOIN e USING (g) JOIN n USING (item_id) GROUP BY 1, 2""",
)
def text_bench_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold eight-word shingles of benchmark items, with the share of the item's shingles."""
    return rounded(X.shingle_overlap(table(spark, d, "documents"), table(spark, d, "benchmark"), 8).drop("jaccard"))
