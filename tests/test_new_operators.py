"""Operators without SQL, held against plain Python or another library."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright import catalog
from sparkwright.operators import arrays, corpus, networks, running
from sparkwright.operators.graph import connected_components
from sparkwright.session import table
from tests.conftest import DATA
from tests.oracle import same

WORDS = ["the", "house", "houses", "housing", "a", "unhappy", "happiness", "über", "x"]


def test_running_totals_equal_a_sort(spark):
    rows = [(random.Random(k).choice([None, 1.5, float(k % 17), float("nan")]), k % 5) for k in range(300)]
    one = spark.createDataFrame(rows, "x double, v int").groupBy("x").agg(F.sum("v").alias("v"))
    for down in (False, True):
        got = {str(r.x): r.upto_v for r in running.running_totals(one, "x", ["v"], down).collect()}
        known = sorted((r for r in one.collect() if r.x is not None), key=lambda r: (math.isnan(r.x), r.x), reverse=down) + [r for r in one.collect() if r.x is None]
        total, want = 0, {}
        for r in known:
            total += r.v
            want[str(r.x)] = total
        assert got == want
    names = spark.createDataFrame([(f"n{k}", 1) for k in range(1500)], "x string, v int")
    assert sorted((r.x, r.upto_v) for r in running.running_totals(names, "x", ["v"]).collect()) == [(x, i + 1) for i, x in enumerate(sorted(f"n{k}" for k in range(1500)))]


def test_expectile_is_the_root(spark):
    values = [float(v) for v in np.random.default_rng(1).gamma(2, 3, 500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for tau in (0.1, 0.5, 0.9):
        m = arrays.expectile(df, "x", tau)
        assert tau * sum(max(v - m, 0) for v in values) == pytest.approx((1 - tau) * sum(max(m - v, 0) for v in values), rel=1e-6)


def test_word_pieces_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    pieces = ["[UNK]", "the", "house", "##s", "##ing", "hous", "un", "##happy", "happi", "##ness", "a", "x", "##x"]
    other = tokenizers.models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]")
    for w in WORDS:
        assert corpus.word_piece(w, set(pieces)) == [t.value for t in other.tokenize(w)]


def test_merges_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    merges = [("h", "o"), ("u", "s"), ("ho", "us"), ("t", "h"), ("th", "e"), ("hous", "e"), ("p", "p")]
    letters = sorted({c for w in WORDS for c in w})
    vocabulary = {t: i for i, t in enumerate([*letters, *(a + b for a, b in merges)])}
    other = tokenizers.models.BPE(vocabulary, merges)
    ranks = {m: i for i, m in enumerate(merges)}
    for w in [*WORDS, "hohohous", "pppp", ""]:
        assert corpus.merge_pairs(w, ranks) == [t.value for t in other.tokenize(w)]


def test_likeliest_pieces_equal_all_segmentations():
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.2, "aba": -6.0, "c": -1.0}

    def best(word):
        if not word:
            return 0.0
        return max(best(word[k:]) + s for k in range(1, len(word) + 1) if (s := scores.get(word[:k], -20.0 if k == 1 else None)) is not None)

    for word in ("abab", "abaabac", "zab", "c", ""):
        pieces = corpus.likeliest_pieces(word, scores, -20.0)
        assert "".join(pieces) == word and sum(scores.get(p, -20.0) for p in pieces) == pytest.approx(best(word))


def test_huffman_codes_are_complete_and_best():
    counts = {"a": 45, "b": 13, "c": 12, "d": 16, "e": 9, "f": 5}
    lengths = corpus.huffman_lengths(counts)
    assert sum(2.0 ** -n for n in lengths.values()) == 1 and sum(counts[s] * n for s, n in lengths.items()) == 224
    assert corpus.huffman_lengths({"x": 3}) == {"x": 1}


def test_bleu_and_chrf(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat today", "the cat sat on the mat today"), (2, "a b c d e", "a b x d e")], "k int, r string, c string")
    both = corpus.bleu(rows, F.split("r", " "), F.split("c", " ")).first()
    assert both.precisions == pytest.approx([11 / 12, 8 / 10, 5 / 8, 4 / 6]) and both.brevity == 1.0
    assert both.bleu == pytest.approx((11 / 12 * 8 / 10 * 5 / 8 * 4 / 6) ** 0.25)
    scores = {r.k: r.chrf for r in corpus.chr_f(rows, "k", F.col("r"), F.col("c")).collect()}
    assert scores[1] == pytest.approx(1.0) and 0 < scores[2] < 1


def test_latent_values_equal_numpy(spark):
    x = np.random.default_rng(2).random((40, 12))
    bag = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(40) for j in range(12)], "doc_id long, token string, weight double")
    terms = spark.createDataFrame([(f"t{j}", j) for j in range(12)], "token string, id int")
    singular, places = corpus.latent_semantics(bag, terms, 4)
    assert singular == pytest.approx(np.linalg.svd(x, compute_uv=False)[:4], rel=1e-4)
    vectors = np.array([r.vector for r in places.orderBy("doc_id").collect()])
    assert np.linalg.norm(vectors, axis=0) == pytest.approx(singular, rel=1e-4)


def test_spanning_forest_equals_kruskal(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(30))) for _ in range(110)] + [(100, 101, 3.0), (5, 5, 0.0)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    weight, links = 0.0, 0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            up[find(a)] = find(b)
            weight, links = weight + w, links + 1
    got = networks.spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()
    assert len(got) == links and sum(r.weight for r in got) == weight


def test_components_of_a_long_path(spark):
    """No number of rounds is enough but that of the fixpoint."""
    order = random.Random(6).sample(range(400), 400)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(n, 0) for n in range(400)}


@pytest.mark.parametrize("name", ["knn_ivf_recall", "knn_lsh_recall"])
def test_recall_of_indexes(spark, small, name):
    assert catalog.QUERIES[name](spark, small).first().recall >= 0.9


def test_elo_equals_a_fold(spark, tiny):
    got = {(r.event_type, r.player): r.rating for r in catalog.QUERIES["series_elo"](spark, tiny).collect()}
    rating = {}
    rows = sorted(table(spark, tiny, "events").collect(), key=lambda r: (r.event_type, r.ts, r.event_id))
    games = sorted(((a.event_type, a.event_id, a, b) for a, b in zip(rows, rows[1:], strict=False) if a.event_type == b.event_type and a.user_id != b.user_id), key=lambda g: g[:2])
    for kind, _, a, b in games:
        x, y = rating.get((kind, a.user_id), 1500.0), rating.get((kind, b.user_id), 1500.0)
        change = 32 * ((1.0 if a.value > b.value else 0.0 if a.value < b.value else 0.5) - 1 / (1 + 10 ** ((y - x) / 400)))
        rating[kind, a.user_id], rating[kind, b.user_id] = x + change, y - change
    assert got == pytest.approx(rating)


def test_answers_at_letters_beyond_ascii(spark, tmp_path):
    """Articles beside accented letters, capital sigma and dotted I, spaces of Unicode at the ends, vertical tabs."""
    texts = ["an\u00e7 la \u00e9a b", "The \u00e8the a\u0301 x", "\u039f\u0394\u039f\u03a3 \u0130a an", "\u00a0the x\u3000", "a\u000bb\u000b\u000bc", "a\u2028an\u0085", "a_the an-x", "the  a", "", None]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["text_normalise_answer"]).fetchall()
    got = catalog.QUERIES["text_normalise_answer"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("hops", [0, 1, 2, 5, 12, None])
def test_all_pairs_within_hops(spark, hops):
    """A cheap path of 20 edges beside dearer, shorter ones."""
    rnd = random.Random(8)
    edges = [(i, i + 1, 1.0) for i in range(20)] + [(rnd.randrange(21), rnd.randrange(21), float(rnd.randrange(5, 60))) for _ in range(25)]
    got = {(r.src, r.dst): r.distance for r in networks.all_pairs_shortest(spark.createDataFrame(edges, "src long, dst long, weight double"), hops).collect()}
    want = {(n, n): 0.0 for n in range(21)}
    for _ in range(21 if hops is None else hops):
        step = dict(want)
        for (a, b), x in want.items():
            for src, dst, w in edges:
                if src == b and x + w < step.get((a, dst), math.inf):
                    step[a, dst] = x + w
        want = step
    assert got == want


def test_all_pairs_equals_sql_where_paths_are_long(spark):
    equal, why = same(catalog.QUERIES["graph_all_pairs"](spark, f"{DATA}/sf0.1"), catalog.ORACLE_SQL["graph_all_pairs"], f"{DATA}/sf0.1")
    assert equal, why


def test_permutation_of_keys_with_equal_numbers(spark, tmp_path):
    """The first eight hex digits of md5 are equal for 3332 and 14736; a repeated key has a place for each row."""
    keys = [14736, *range(3300, 3400), 3332, 14736]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r.place, r.s_suppkey) for r in catalog.QUERIES["sample_permutation"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == sorted((place, key) for key, place in con.execute(catalog.ORACLE_SQL["sample_permutation"]).fetchall())


def test_lsh_finds_the_best_of_its_buckets(spark):
    """Against plain Python; more rows than a shard holds of one bucket, equal vectors, a zero and missing ones."""
    from sparkwright.operators import similarity as V

    rnd = np.random.default_rng(2)
    vectors = np.round(rnd.standard_normal((300, 4)), 2)
    vectors[40:60], vectors[70] = vectors[40], 0
    rows = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(vectors)), (None, [1.0] * 4), (900, None)], "vec_id long, embedding array<double>")
    found = V.lsh_nearest(rows, rows.where("vec_id % 20 = 0"), 3, 4, bits=5, tables=2)
    got = sorted((r.query_id, r.rank, r.neighbour, round(r.distance, 9)) for r in found.collect())
    keys = np.array([[tuple(V.hyperplanes(4, 5, t) @ v >= 0) for t in range(2)] for v in vectors])
    want = []
    for q in range(0, 300, 20):
        near = [i for i in range(300) if i != q and (keys[i] == keys[q]).all(axis=1).any()]
        norm = lambda i: math.sqrt((vectors[i] ** 2).sum())
        best = sorted((round(1 - vectors[i] @ vectors[q] / (norm(i) * norm(q)) if norm(i) * norm(q) else 1.0, 9), i) for i in near)[:3]
        want += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(best)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-8)
    # candidate pairs are no rows: the only join is that of blocks with shards
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "shard" in joins[0] and "key" not in joins[0]
