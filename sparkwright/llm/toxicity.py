"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed terms: folded words, and prefixes of words. The score is the sigmoid of
w0 + sum(w_i x_i) + sum over pairs of <v_i, v_j> x_i x_j, so a pair of terms can weigh more (or less) than its parts.
The pair sum is computed in linear time from sums and sums of squares.

The model is fitted on a bounded sample of labelled rows (``labelled.TRAIN_ROWS_PER_CLASS``) on the driver: workers
return the hashed terms of that sample, chi-squared screening keeps the terms that tell the classes apart, and Adagrad
fits the weights. Scoring is one pass of Arrow batches over all texts, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm import labelled
from sparkwright.llm import textkernel as K
from sparkwright.llm.workspace import Workspace, ship, trim, trimmed

#: Hash space of terms, terms kept by screening, factors of a term.
SPACE_BITS, TERMS, FACTORS = 20, 4096, 8
EPOCHS, RATE, L2 = 30, 0.1, 1e-4
#: Lengths (bytes) of the word prefixes that are terms beside the words themselves.
PREFIXES = (4, 6)
THRESHOLD = 0.7

#: Letters, digits and the bytes of longer characters belong to words; all else separates them.
_BREAK = np.ones(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BREAK[_lo:_hi] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds (n + 1) and the distinct hashed terms of every text."""
    data, offsets = K.column_bytes(column)
    docs, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo, hi in K.windows(data, offsets, _BREAK):
        part = K.LOWER[data[lo:hi]]
        starts, ends = K.word_spans(part, np.clip(offsets, lo, hi) - lo, _BREAK)
        doc = np.searchsorted(offsets, starts + lo, "right") - 1
        with np.errstate(over="ignore"):
            for k in (0, *PREFIXES):
                long = (ends - starts) > k if k else slice(None)
                s, e = starts[long], ends[long]
                h = K.hash_spans(part, s, s + k if k else e)
                found.append((K.mix(h + np.uint64(k)) >> np.uint64(64 - SPACE_BITS)).astype(np.int64))
                docs.append(doc[long])
    return labelled.sorted_unique(np.concatenate(docs), np.concatenate(found), len(offsets) - 1)


class FactorizationMachine:
    """Weights over the screened terms; ``place`` maps a hashed term to its index, or -1."""

    def __init__(self, place: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.place, self.w0, self.w, self.v = place, w0, w, v

    def margins(self, bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = self.place[values]
        rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[at >= 0]
        at = at[at >= 0]
        n = len(bounds) - 1
        out = self.w0 + np.bincount(rows, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(*terms(column)), -30, 30)))


def fit(rows: list[tuple[int, list[int]]], seed: int = 7) -> FactorizationMachine:
    """Screen terms by chi-squared, then minimise the logistic loss with Adagrad. Rows are (label, hashed terms)."""
    space = 1 << SPACE_BITS
    place = np.full(space, -1, dtype=np.int32)
    y = np.array([label for label, _ in rows], dtype=float)
    if not len(y) or y.min() == y.max():  # one class or none: its share is all there is to learn
        p = (y.sum() + 0.5) / (len(y) + 1)
        return FactorizationMachine(place, float(np.log(p / (1 - p))), np.zeros(1), np.zeros((1, FACTORS)))
    lists = [np.asarray(t, dtype=np.int64) for _, t in rows]
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    seen = np.bincount(flat, minlength=space).astype(float)
    hit = np.bincount(flat, weights=y[owner], minlength=space)
    n, p = len(y), y.mean()
    expected = seen * p
    spread = seen * p * (1 - p) * (1 - seen / n)
    chi = np.where((seen >= 3) & (spread > 0), (hit - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:TERMS]
    best = best[chi[best] > 10.83]  # the 0.1 % point of chi-squared with one degree of freedom
    place[best] = np.arange(len(best))
    at = place[flat]
    owner, at = owner[at >= 0], at[at >= 0]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    m = max(1, len(best))
    w0, w, v = float(np.log(p / (1 - p))), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))
    g0, gw, gv = 1e-6, np.full(m, 1e-6), np.full((m, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            batch = order[lo : lo + 64]
            take = [at[bounds[i] : bounds[i + 1]] for i in batch]
            rows_of = np.repeat(np.arange(len(batch)), [len(t) for t in take])
            j = np.concatenate(take)
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, rows_of, v[j])
            squares = np.zeros((len(batch), FACTORS))
            np.add.at(squares, rows_of, v[j] ** 2)
            margin = w0 + np.bincount(rows_of, w[j], len(batch)) + 0.5 * (sums**2 - squares).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]
            d0 = error.mean()
            g0 += d0 * d0
            w0 -= RATE * d0 / np.sqrt(g0)
            own, back = np.unique(j, return_inverse=True)
            dw = np.bincount(back, error[rows_of], len(own)) / len(batch) + L2 * w[own]
            gw[own] += dw * dw
            dv = np.zeros((len(own), FACTORS))
            np.add.at(dv, back, error[rows_of, None] * (sums[rows_of] - v[j]))
            dv = dv / len(batch) + L2 * v[own]
            gv[own] += dv * dv
            w[own] -= RATE * dw / np.sqrt(gw[own])
            v[own] -= 0.5 * RATE * dv / np.sqrt(gv[own])
    return FactorizationMachine(place, w0, w, v)


def _sample_terms(batches):
    for b in batches:
        for part in _parts(b):
            bounds, values = terms(part.column(2))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["k", "label", "terms"])


def _parts(b: pa.RecordBatch, size: int = 1 << 20):
    at = 0
    for part in labelled.slices(b.column(b.num_columns - 1), size):
        yield b.slice(at, len(part))
        at += len(part)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = labelled.TRAIN_ROWS_PER_CLASS) -> FactorizationMachine:
    """Fit on up to ``rows`` labelled texts of each class that are not held out."""
    ws = Workspace(docs.sparkSession, "toxicity")
    sample = labelled.training_rows(ws, docs, labels, id_col, text_col, label_col, rows)
    found = sample.mapInArrow(trimmed(_sample_terms), sample.select("k", "label").schema.add("terms", T.ArrayType(T.IntegerType()))).toArrow().sort_by("k")
    model = fit([(label, t) for label, t in zip(found["label"].to_pylist(), found["terms"].to_numpy(), strict=True)])
    del found
    trim()
    return model


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score in [0, 1], predicted (1 if score >= threshold).

    Null and empty texts are scored as texts without terms, by the intercept. Repeated rows get equal scores. Only the
    two named columns are read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(part.column(1)))], names=[id_col, "score"])

    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    scored = own.mapInArrow(trimmed(run), own.select(id_col).schema.add("score", "double"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def filter_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold; decided in the one pass over the rows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            at = 0
            for part in labelled.slices(b.column(place).cast(pa.string())):
                low = shared.value.scores(part) < threshold
                yield b.slice(at, len(part)).filter(pa.array(low))
                at += len(part)

    return docs.mapInArrow(trimmed(run), docs.schema)
