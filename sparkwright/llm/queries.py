"""The registered queries of this package: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import labelled
from sparkwright.llm.decontaminate import contaminated
from sparkwright.llm.exact_search import top_inner_products
from sparkwright.llm.html_text import extract_main_text
from sparkwright.llm.mixing import mix_sources
from sparkwright.llm.near_duplicates import near_duplicate_groups
from sparkwright.llm.quality import score_quality, train_quality
from sparkwright.llm.secret_scan import scan_secrets
from sparkwright.llm.token_output import token_digest
from sparkwright.llm.toxicity import score_toxicity, train_toxicity
from sparkwright.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", labelled.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", labelled.held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_inner_products(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), "copies", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_quality_knn": op2_quality_knn,
    "op3_kdtree_topk": op3_kdtree_topk,
    "op4_html_text": op4_html_text,
    "op5_source_mix": op5_source_mix,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_minhash_groups": op8_minhash_groups,
    "op9_token_ids": op9_token_ids,
    "op10_benchmark_leaks": op10_benchmark_leaks,
}

#: The other results hold trained scores, keyed rounding, candidate search, parsing or tokens, which SQL can't state.
ORACLE_SQL: dict[str, str] = {
    "op3_kdtree_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_warc_round_trip": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)""",
}
