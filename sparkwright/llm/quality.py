"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is a tf-idf vector over hashed terms that describe its form as well as its words: word shapes, the first and
last bytes of words, bytes outside words, word lengths, how often lines and words repeat. A truncated SVD of the
labelled sample gives latent directions. The labelled latent vectors are broadcast (a bounded number of them); every
text is projected, and blocked matrix products give its exact cosine with each. The nearest vote for their label,
weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm import labelled
from sparkwright.llm import textkernel as K
from sparkwright.llm.toxicity import _parts
from sparkwright.llm.workspace import Workspace, ship, trim, trimmed

#: Columns of the hashed term space, latent directions, voters, labelled rows of each class at most.
SPACE, RANK, NEIGHBOURS, ROWS_PER_CLASS = 4096, 48, 15, 2000
THRESHOLD = 0.5
#: Texts whose cosines are computed at once.
BLOCK = 512
#: Unit vectors are multiples of 1 / GRID in inner products. Products of two of them and all their partial sums are then
#: whole multiples of 1 / GRID**2 up to about 1, which doubles hold exactly, so no order of adding changes a bit.
GRID = float(1 << 25)
#: A nearest voter is found by its cosine in steps of 1 / STEPS, ties by its place.
STEPS = 1 << 38

#: Bytes by kind: upper case, lower case, digit, part of a longer character; others stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 48, 65, 97, 128
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[48, 65, 97, 128]] = True


def _bucket(share: np.ndarray, tag: int) -> np.ndarray:
    """Terms for a value in [0, 1]: one for each of eight bounds that it reaches."""
    level = np.clip((share * 8).astype(np.int64), 0, 7)
    return level + 8 * tag


def features(column: pa.Array) -> np.ndarray:
    """Counts of the hashed terms, one row per text (float32). Whole texts are counted."""
    data, offsets = K.column_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, SPACE), dtype=np.float32)
    flat = out.reshape(-1)

    def count(rows: np.ndarray, terms: np.ndarray, weight=None) -> None:
        key = rows * SPACE + terms
        own, many = np.unique(key, return_counts=True) if weight is None else (key, weight)
        flat[own] += many

    space = SPACE - 256
    words_all = np.zeros(n)
    word_docs, word_keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo, hi in K.windows(data, offsets, K.SPACE):
        part = data[lo:hi]
        kind = _KIND[part]
        own = np.clip(offsets, lo, hi) - lo
        starts, ends = K.word_spans(part, own)
        if not len(starts):
            continue
        doc = np.searchsorted(offsets, starts + lo, "right") - 1
        # shapes: kinds with runs collapsed
        change = np.ones(len(kind), dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        change[starts] = True
        inside = np.zeros(len(kind) + 1, dtype=np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        keep = change & (np.cumsum(inside[:-1]) > 0)
        run = np.concatenate([[0], np.cumsum(keep)])
        with np.errstate(over="ignore"):
            shape = K.hash_spans(kind[keep], run[starts], run[ends])
            count(doc, (K.mix(shape) % np.uint64(space)).astype(np.int64))
            tail = K.hash_spans(part, np.maximum(starts, ends - 2), ends)
            count(doc, (K.mix(tail + np.uint64(1)) % np.uint64(space)).astype(np.int64))
            word = K.hash_spans(K.LOWER[part], starts, ends)
            count(doc, (K.mix(word + np.uint64(2)) % np.uint64(space)).astype(np.int64))
        marks = np.flatnonzero(~_LETTER[kind] & ~K.SPACE[part])
        count(np.searchsorted(offsets, marks + lo, "right") - 1, part[marks].astype(np.int64) % 128 + space)
        length = np.minimum(ends - starts, 31)
        count(doc, length + space + 128)
        words_all += np.bincount(doc, minlength=n)
        word_docs.append(doc)
        word_keys.append((word >> np.uint64(32)).astype(np.int64))
    every = np.arange(n)
    # windows are for the memory of what adds up; distinct words and lines are those of whole texts
    repeats = (_repeated(np.concatenate(word_docs), np.concatenate(word_keys), n), _repeated(*_lines(data, offsets), n))
    for tag, share in enumerate(repeats):
        count(every, _bucket(share, tag) + space + 160, np.maximum(1, words_all / 20).astype(np.float32))
    size = np.clip(np.log2(words_all + 1).astype(np.int64), 0, 15)
    count(every, size + space + 176, np.maximum(1, words_all / 20).astype(np.float32))
    return out


def _repeated(docs: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For every text the share of its items that repeat an earlier one."""
    bounds, _ = labelled.sorted_unique(docs, keys, n)
    return 1 - np.diff(bounds) / np.maximum(np.bincount(docs, minlength=n), 1)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 32-bit hash) of every line that is not empty; a line longer than a window is hashed by itself."""
    docs, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo, hi in K.windows(data, offsets, _NEWLINE):
        starts, ends = K.word_spans(data[lo:hi], np.clip(offsets, lo, hi) - lo, _NEWLINE)
        docs.append(np.searchsorted(offsets, starts + lo, "right") - 1)
        if hi - lo > 2 * K.WINDOW:
            own = np.array([xxhash.xxh64_intdigest(data[lo + a : lo + b]) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)
        else:
            own = K.hash_spans(data[lo:hi], starts, ends)
        keys.append((own >> np.uint64(32)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(keys)


_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


class LatentVoter:
    """idf weights, latent directions, the labelled unit vectors and their labels."""

    def __init__(self, idf, directions, vectors, labels, base):
        self.idf, self.directions, self.vectors, self.labels, self.base = idf, directions, vectors, labels, base

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = _grid(_tfidf(counts, self.idf)) @ self.directions
        return _grid(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.base)
        if not len(self.labels):
            return out
        for lo in range(0, len(column), BLOCK):
            x = self.latent(features(column.slice(lo, BLOCK)))
            n = len(self.vectors)
            key = np.rint((x @ self.vectors.T) * -STEPS).astype(np.int64) * n + np.arange(n)
            k = min(NEIGHBOURS, n)
            # sorted, so that the votes are added in one order
            step, near = np.divmod(np.sort(np.partition(key, k - 1, axis=1)[:, :k], axis=1), n)
            weight = np.maximum(step / -STEPS, 0)
            for _ in range(3):
                weight = weight * weight
            votes = (weight * self.labels[near]).sum(axis=1) + 1e-6 * self.base
            out[lo : lo + BLOCK] = votes / (weight.sum(axis=1) + 1e-6)
        return np.clip(out, 0, 1)


def _grid(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(float) * GRID) / GRID


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> LatentVoter:
    """Randomised SVD of the tf-idf matrix of the sample."""
    if not len(labels) or labels.min() == labels.max():
        base = float((labels.sum() + 0.5) / (len(labels) + 1))
        return LatentVoter(None, None, None, np.zeros(0), base)
    idf = np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = _tfidf(counts, idf)
    rng = np.random.default_rng(seed)
    rank = min(RANK, *x.shape)
    y = x @ rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x @ (x.T @ np.linalg.qr(y)[0]))
        y = q
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    del x
    model = LatentVoter(idf, np.ascontiguousarray(_grid(vt[:rank].T)), None, labels.astype(float), float(labels.mean()))
    model.vectors = np.concatenate([model.latent(counts[lo : lo + BLOCK]) for lo in range(0, len(counts), BLOCK)])
    return model


def _sample_counts(batches):
    for b in batches:
        for part in _parts(b, 1 << 20):
            x = features(part.column(2))
            rows, at = np.nonzero(x)
            bounds = np.searchsorted(rows, np.arange(len(x) + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x[rows, at]))],
                names=["k", "label", "terms", "counts"],
            )


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS_PER_CLASS) -> LatentVoter:
    """Fit on up to ``rows`` labelled texts of each class that are not held out."""
    ws = Workspace(docs.sparkSession, "quality")
    sample = labelled.training_rows(ws, docs, labels, id_col, text_col, label_col, rows)
    found = sample.mapInArrow(trimmed(_sample_counts), sample.select("k", "label").schema.add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.FloatType()))).toArrow().sort_by("k")
    counts = np.zeros((found.num_rows, SPACE), dtype=np.float32)
    for i, (t, c) in enumerate(zip(found["terms"].to_numpy(), found["counts"].to_numpy(), strict=True)):
        counts[i, t] = c
    model = fit(counts, found["label"].to_numpy())
    del counts, found
    trim()
    return model


def score_quality(docs: DataFrame, model: LatentVoter, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score in [0, 1], predicted (1 if score >= threshold).

    Null and empty texts have a zero vector, get no similar neighbour and score the sample's share of label 1. Repeated
    rows get equal scores, as a score doesn't depend on the texts beside it. Only the two named columns are read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.asarray(shared.value.scores(part.column(1)), dtype=float))], names=[id_col, "score"])

    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    scored = own.mapInArrow(trimmed(run), own.select(id_col).schema.add("score", "double"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
