import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import quality, toxicity
from sparkwright.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.1"


def check(spark, name, label, threshold, least):
    """Held-out accuracy, and that the result's columns follow from the id and the score."""
    got = QUERIES[name](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id", "left").collect()
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    own = [r for r in got if r.held_out and r[label] is not None]
    assert sum(r.predicted == r[label] for r in own) / len(own) >= least


def test_toxicity_held_out(spark):
    check(spark, "op1_toxicity_fm", "toxic", 0.7, 0.97)


def test_quality_held_out(spark):
    check(spark, "op2_quality_knn", "quality", 0.5, 0.97)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    """Flipping the labels of held-out rows changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train_toxicity(docs, x) for x in (labels, flipped))
    assert a.w0 == b.w0 and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_interactions_are_learnt():
    """Two terms that are harmless alone and toxic together: no additive model tells them apart."""
    a, b = (int(toxicity.terms(pa.array([w]))[1][0]) for w in ("red", "blue"))
    rows = [(0, [a]), (0, [b]), (1, [a, b]), (0, [])] * 200
    model = toxicity.FactorizationMachine(*(lambda m: (m.place, m.w0, m.w, m.v))(toxicity.fit(rows, seed=1)))
    s = model.scores(pa.array(["red", "blue", "red blue", ""]))
    assert s[2] > 0.7 and max(s[0], s[1], s[3]) < 0.5


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_odd_rows(spark, kind):
    train, score = (toxicity.train_toxicity, toxicity.score_toxicity) if kind == "toxicity" else (quality.train_quality, quality.score_quality)
    column = "toxic" if kind == "toxicity" else "quality"
    docs = spark.createDataFrame([(i, f"plain words {i}" if i % 2 else f"awful words {i}") for i in range(60)] + [(None, "x"), (70, None), (71, ""), (72, "a" * 200_000), (73, "b c " * 60_000), (1, "plain words 1")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None), (99, 5)], f"doc_id long, {column} int")
    got = score(docs, train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    nothing = score(docs, train(docs, labels.limit(0))).collect()
    assert len({r.score for r in nothing}) == 1
    assert score(docs.limit(0), train(docs, labels)).count() == 0


def test_windows_of_a_long_text_count_alike():
    """Texts longer than a window give the same terms as short ones."""
    words = [f"w{i % 977}" for i in range(600_000)]
    long, short = pa.array([" ".join(words)]), pa.array([" ".join(sorted(set(words)))])
    assert np.array_equal(toxicity.terms(long)[1], toxicity.terms(short)[1])


def test_pair_sums_equal_brute_force():
    """The margin of a text is the intercept, the weights of its terms and the inner product of every pair's factors."""
    rng = np.random.default_rng(3)
    place = np.full(1 << toxicity.SPACE_BITS, -1, dtype=np.int32)
    texts = ["the cat and the dog", "a", "", "insults at groups and cats", "the the the"]
    bounds, values = toxicity.terms(pa.array(texts))
    known = np.unique(values)[::2]
    place[known] = np.arange(len(known))
    model = toxicity.FactorizationMachine(place, 0.3, rng.normal(size=len(known)), rng.normal(size=(len(known), toxicity.FACTORS)))
    for i, got in enumerate(model.margins(bounds, values)):
        at = [place[v] for v in values[bounds[i] : bounds[i + 1]] if place[v] >= 0]
        want = 0.3 + sum(model.w[j] for j in at) + sum(model.v[a] @ model.v[b] for k, a in enumerate(at) for b in at[:k])
        assert got == pytest.approx(want)


def test_votes_equal_brute_force():
    """A score is the similarity-weighted share of label 1 among the nearest labelled vectors, cosines being exact."""
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(rng.choice(["a", "Bc", "d!", "12", "e\nf"], size=rng.integers(1, 40))) for _ in range(700)])
    labels = rng.integers(0, 2, 700)
    model = quality.fit(quality.features(texts), labels)
    got = model.scores(texts)
    x = model.latent(quality.features(texts)).astype(float)
    for i in range(0, 700, 70):
        cosine = [float(x[i] @ v) for v in model.vectors.astype(float)]
        near = sorted(range(len(cosine)), key=lambda j: -cosine[j])[: quality.NEIGHBOURS]
        weight = [max(cosine[j], 0) ** 8 for j in near]
        want = (sum(w * labels[j] for w, j in zip(weight, near, strict=True)) + 1e-6 * model.base) / (sum(weight) + 1e-6)
        assert got[i] == pytest.approx(want, abs=0.02)


def test_scores_do_not_depend_on_the_texts_beside():
    """A text has the same score to the last bit alone, at any place of a block and in blocks of any size; equally near
    voters are taken by their place."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "Bc", "d!", "12", "e\nf", "ghi", "k"], size=rng.integers(1, 40))) for _ in range(600)]
    labels = rng.integers(0, 2, 1200)
    model = quality.fit(quality.features(pa.array(texts + texts)), labels)
    want = [model.scores(pa.array([t]))[0] for t in texts]
    for shift, size in ((0, 2), (0, 3), (1, 7), (5, 64), (3, 511), (0, 600)):
        got = np.concatenate([model.scores(pa.array(texts[lo : lo + size])) for lo in range(shift, len(texts), size)])
        assert got.tolist() == want[shift:]


@pytest.mark.parametrize("unit", ["some words of a line that repeats\n", "one two three four five six seven eight nine ten "])
def test_repetition_does_not_depend_on_the_length(unit):
    """A text whose second half repeats its first has half its words and lines repeated, beyond any window's size too."""
    for lines in (3000, 12_000):
        half = "".join(f"w{i} x{i * 7} y{i * 13} " + ("\n" if unit[-1] == "\n" else "") for i in range(lines))
        counts = quality.features(pa.array([half, half + half]))
        levels = counts[:, quality.SPACE - 256 + 160 : quality.SPACE - 256 + 168].argmax(axis=1)
        assert levels.tolist() == [0, 4]
    long_line = "z" * 700_000
    docs, keys = quality._lines(*__import__("sparkwright.llm.textkernel", fromlist=["x"]).column_bytes(pa.array([f"{long_line}\na\n{long_line}\n", "a\n\nb"])))
    assert docs.tolist() == [0, 0, 0, 1, 1] and keys[0] == keys[2] != keys[1] == keys[3]
