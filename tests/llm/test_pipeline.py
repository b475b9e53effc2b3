import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwright.llm.workspace import Workspace
from tests.llm import brute


def test_stages_on_the_small_corpus(spark, small):
    """Each stage against a plain statement of what it may keep, on its own input."""
    ws = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.keep(stage(spark, docs, small), name)
        seen.append(docs.collect())
        if name != "token_output":
            assert docs.columns == columns
            assert {tuple(r) for r in seen[-1]} <= {tuple(r) for r in seen[-2]}
    start, clean, single, unleaked, mixed, tokens = seen
    toxic = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in start} - {r.doc_id for r in clean}
    assert len(gone & toxic) >= 0.6 * len(toxic)
    groups = brute.groups([(r.doc_id, r.text) for r in clean], 5, 80)
    assert {r.doc_id for r in single} == {i for i, (_, _, kept) in groups.items() if kept}
    assert len(unleaked) >= 0.9 * len(single)
    check = {}
    for r in mixed:
        check[r.doc_id] = check.get(r.doc_id, 0) + 1
    assert max(check.values()) <= 2
    total = sum(len(brute.WORD.findall(r.text)) for r in unleaked)
    assert abs(sum(len(brute.WORD.findall(r.text)) for r in mixed) - 1.5 * total) < 0.05 * total
    assert len(tokens) == len(mixed) and {r.doc_id for r in tokens} == {r.doc_id for r in mixed}
    assert sorted(r.start for r in tokens)[0] == 0


CLASHES = ("gone", "mixed_doc", "mixed_times", "mixed_copy", "_n", "_gone", "id", "label", "score", "copies", "band", "component_id")


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    rows = [(i, f"plain words number {i} and {i * 7} with some more {i * 13} of them", "en", f"s{i % 3}", 10) for i in range(40)]
    rows += [(None, "text of nobody", "en", "s0", 14), (None, "text of nobody", "en", "s0", 14), (50, None, None, None, None), (51, "", "en", "s1", 0), (52, "long " * 100_000, "en", None, 500_000)]
    rows += [(53, "the same words in the same order twice", "en", "s1", 38)] * 2 + [(54, "the same words in the same order twice", "en", "s2", 38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, tiny, empty):
    ws = Workspace(spark, "test-odd")
    docs = odd_documents(spark).limit(0) if empty else odd_documents(spark)
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.keep(stage(spark, docs, tiny), name)
        seen.append(docs.collect())
        if name != "token_output":
            assert docs.columns == columns and {tuple(r) for r in seen[-1]} <= {tuple(r) for r in seen[-2]}
    if empty:
        assert not any(seen)
        return
    start, clean, single, unleaked, mixed, tokens = seen
    ids = lambda rows: sorted(str(r.doc_id) for r in rows)
    assert ids(clean) == ids(start)
    assert ids(single) == sorted([*map(str, range(40)), "None", "None", "50", "51", "52", "53"])
    assert ids(unleaked) == ids(single)
    taken = ids(mixed)
    assert taken.count("None") == 2 and max(taken.count(str(i)) for i in range(54)) <= 2
    assert sorted(ids(tokens)) == taken
    assert {r.n_tokens for r in tokens if r.doc_id in (50, 51)} <= {1}
