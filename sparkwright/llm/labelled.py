"""Bounded training samples of labelled rows, and hashed terms of texts, for the classifiers."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import textkernel as K
from sparkwright.llm.workspace import Workspace

#: Labelled rows of each class that a classifier is fitted on, at most (a documented bound; smallest hash of the id first).
TRAIN_ROWS_PER_CLASS = 2500
#: Held-out rows are those whose crc32 of the id as text leaves this remainder by FOLDS.
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def is_held_out(value: object) -> bool:
    return zlib.crc32(str(value).encode()) % FOLDS == HELD_OUT


def training_rows(ws: Workspace, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(label, text) of up to ``rows`` labelled rows of each class that are not held out. The ids are chosen from the
    labels alone, so the join has a bounded, broadcast side and the texts are not shuffled."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label")).where(F.col("k").isNotNull() & F.col("label").isin(0, 1)).where(~held_out("k"))
    known = known.groupBy("k").agg(F.max("label").alias("label"))
    order = [F.xxhash64(F.col("k"), F.lit("train")), F.col("k")]
    chosen = known.where("label = 0").orderBy(*order).limit(rows).unionByName(known.where("label = 1").orderBy(*order).limit(rows))
    chosen = ws.keep(chosen, "chosen")
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "k").select("k", "label", "text")


def sorted_unique(docs: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs as row bounds (n + 1) and values; values fit in 32 bits."""
    key = np.unique((docs.astype(np.uint64) << np.uint64(32)) | values.astype(np.uint64))
    bounds = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    return bounds, (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def slices(column: pa.Array, size: int = 1 << 20):
    """Parts of a string column with about so many bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = K.column_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield column.slice(at, end - at)
        at = end
