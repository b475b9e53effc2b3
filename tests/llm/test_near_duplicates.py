import pytest
from pyspark.sql import functions as F

from sparkwright.llm.near_duplicates import bands_for, near_duplicate_groups
from sparkwright.llm.queries import QUERIES
from sparkwright.llm.workspace import Workspace
from tests.llm import brute


def rows(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_whole_table_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op8_minhash_groups"](spark, small)) == brute.groups(docs, 3, 85)


def test_large_family_of_borderline_copies(spark):
    """A family whose members are at 0.7 to 0.95 from each other: components need pairs beyond any one pivot."""
    import random

    random.seed(3)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(300):
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(60)] = f"x{random.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert rows(near_duplicate_groups(df, words=3, percent=85)) == brute.groups(docs, 3, 85)


def test_odd_rows(spark):
    docs = [(1, "A b c d"), (2, "a B c d"), (3, ""), (4, None), (5, " \t\n"), (6, "a"), (7, "A"), (8, "a b"), (None, "a b c d"), (9, "x " * 50_000), (9, "x " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("band", F.lit(1))
    got = near_duplicate_groups(df, words=3, percent=85).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by_id == {1: (2, 1, True), 2: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False), 8: (1, 8, True), 9: (1, 9, True)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicate_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [200, 800])
def test_pairs_of_a_family_grow_as_its_rows(spark, monkeypatch, rows):
    """Of a family whose members are near one another but hardly linked, each round meets a pivot for each row."""
    import random

    met = {}
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name: met.setdefault(name, keep(self, df, name)))
    random.seed(4)
    base = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(f"x{random.randrange(10**6)}" if random.random() < 0.04 else w for w in base)) for i in range(rows)]
    got = near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute.groups(docs, 3, 85)
    assert all(met[n].count() <= rows for n in met if n.startswith("pairs"))


def test_bands_follow_the_similarity():
    for percent in (50, 70, 80, 85, 95, 100):
        assert bands_for(percent) % 8 == 0 and (1 - (percent / 100) ** 4) ** bands_for(percent) <= 1e-6


def test_tables_of_the_last_comparison_grow_as_rows(spark, monkeypatch):
    """Members at 0.8 from one another pass the estimate but are no links; none of their pairs is a row of a table."""
    met = {}
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name: met.setdefault(name, keep(self, df, name)))
    base = [f"w{k}" for k in range(120)]
    docs = [(i, " ".join(f"x{i}" if k in (20 + i % 3, 60 + i % 5, 100 + i % 7) else w for k, w in enumerate(base)) + f" y{i} z{i} v{i} u{i}") for i in range(300)]
    got = near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute.groups(docs, 3, 85)
    assert "links-rest" in met
    assert all(met[n].count() <= 300 * bands_for(85) for n in met)
