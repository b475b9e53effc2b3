"""The corpus pipeline: each stage applies one operator of ``sparkwright.llm`` to all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and rereads for the next.
All but the last return the columns of ``documents`` (and any others that the table has, whatever their names). An empty
table gives an empty one at every stage.

Rows with a null doc_id can't be named by a decision about another row, so they stay where a stage decides by id (near
duplicates, decontamination, mixing) and are judged by their own text in the first. Rows that repeat a doc_id are one
document: a decision about it holds for all of them, and of those with equal texts one row stays after near duplicates.
Null and empty texts are never toxic, have no duplicates, no leaks, size 0 in the mix, and one token, the end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.decontaminate import contaminated
from sparkwright.llm.mixing import mix_sources
from sparkwright.llm.near_duplicates import near_duplicate_groups
from sparkwright.llm.queries import tokenizer_path
from sparkwright.llm.token_output import token_digest
from sparkwright.llm.toxicity import filter_toxic, train_toxicity
from sparkwright.llm.workspace import Workspace, sized


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(ws: Workspace, docs: DataFrame, ids: DataFrame, label: str = "gone") -> DataFrame:
    """The rows whose doc_id is not among the ids; the ids are broadcast only if they are few."""
    name = _fresh(docs, "gone")
    gone = sized(ws.keep(ids.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct(), label))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the factorization machine scores 0.7 or more go. Equal texts get equal scores."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id (five-word shingles,
    similarity 0.8 or more). Of rows that repeat both its doc_id and its text, one stays."""
    ws = Workspace(spark, "stage-dedup")
    groups = near_duplicate_groups(docs.select("doc_id", "text"), words=5, percent=80)
    kept = _without(ws, docs, groups.where("not kept"))
    again = ws.keep(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return _without(ws, kept, again, "single").unionByName(kept.join(sized(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(Workspace(spark, "stage-leaks"), docs, leaks)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times."""
    ws = Workspace(spark, "stage-mix")
    doc, times, copy = _fresh(docs, "mixed_doc"), _fresh(docs, "mixed_times"), _fresh(docs, "mixed_copy")
    copies = mix_sources(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias(doc)).agg(F.max("copies").cast("int").alias(times))
    taken = docs.join(sized(ws.keep(copies, "copies")), F.col("doc_id") == F.col(doc), "left").withColumn(times, F.coalesce(F.col(times), F.lit(1)))
    return taken.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Parquet files; their index: doc_id, start, n_tokens, ids_crc32. A document taken twice has two rows."""
    return token_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Trained scores, candidate search and tokens are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
