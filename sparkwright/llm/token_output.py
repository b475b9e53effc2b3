"""Token ids as Parquet list columns.

Texts are dealt by ranges of the id, sorted, encoded in Arrow batches and written by Spark's Parquet writer, whose
commit protocol survives lost executors and repeated tasks. Version 2 pages give lengths and ids that don't fit a
dictionary a delta encoding; row groups and pages have stated sizes, and page indexes are written, so a reader can
fetch the metadata columns, or the ids of a range of documents, without the rest of a file.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.llm import textkernel as K
from sparkwright.llm.toxicity import _parts
from sparkwright.llm.workspace import Workspace, ship, sized, small_batches, trimmed

#: Bytes of a row group and of a page before compression.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Words whose ids a worker remembers (about 200 bytes each).
CACHED_WORDS = 300_000
#: Bytes of texts cut at once, and words that the model is given at once.
SLICE, TOGETHER = 4 << 20, 16_384
#: White space before a space or a line feed.
_RUN = re.compile(r"\s[ \n]")
_ASCII_BLANK = np.zeros(256, dtype=bool)
_ASCII_BLANK[[*range(9, 14), *range(28, 33)]] = True
#: Letters of Latin scripts up to U+024F, then ASCII punctuation.
_LATIN = r"\A(?P<base>[A-Za-z\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{024f}]+)(?P<tail>[!-/:-@\[-`{-~]*)\z"
#: Appended to every document.
END_ID = 2
WRITE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Code points of the letters; a line feed stays itself, between words.
_BYTE_LETTERS = np.array([10 if b == 10 else ord(c) for b, c in sorted(_byte_letters().items())], dtype="<u4")


class WordCache(dict):
    """Ids (as bytes) of words led by a space, or by a line feed that is part of the key, so that a word of a worker's
    texts is encoded once.

    A byte-level pre-tokenizer always starts a token at a space or line feed that follows a non-space, and its pattern
    looks back at nothing; so a text that is cut there encodes piece by piece to the same ids. Texts with white space
    before one of the two are encoded whole, as are all texts of another kind of tokenizer. Arrow cuts the texts of a
    batch and gives each distinct word a number, so only distinct words are Python objects.

    For the same reason the unknown words of a batch are encoded as one text, whose ids are cut where a token starts
    with the lead. A word of Latin letters is one token of the pre-tokenizer, and punctuation after it another; so these
    words go to the tokenizer's model without the pattern, and are kept without the marks behind them. Each of two
    generations holds at most ``size`` words, the younger one begins anew after half of that.
    """

    def __init__(self, tokenizer, size: int = CACHED_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.size, self.older, self.tails = tokenizer, size, {}, {"": b""}
        # the byte-level letters of a space and of a line feed
        self._plain = type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and tokenizer.normalizer is None
        vocabulary = tokenizer.get_vocab()
        self._starts = {lead: np.zeros(max(vocabulary.values()) + 1, dtype=bool) for lead in " \n"}
        for token, i in vocabulary.items():
            for lead, letter in ((" ", "\u0120"), ("\n", "\u010a")):
                self._starts[lead][i] = token.startswith(letter)
        # the same model on byte-level letters, one word a line
        self._lines = Tokenizer(tokenizer.model)
        self._lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, tokenizer, text: str, lead: str, words: int) -> list[bytes] | None:
        """Ids of the words of a text; None if not just their first tokens start with the lead."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<i4")
        at = np.flatnonzero(self._starts[lead][ids])
        if len(at) != words or (words and at[0]):
            return None
        raw, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        return [raw[i:j] for i, j in pairwise(cuts)]

    def _together(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words that all follow the lead (which is not in the words)."""
        found = self._cut(self.tokenizer, lead + lead.join(words), lead, len(words)) if words else []
        return self._encode([lead + w for w in words]) if found is None else found

    def _latin(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, led by a space."""
        out: list[bytes] = []
        for lo in range(0, len(words), TOGETHER):
            some = words[lo : lo + TOGETHER]
            letters = _BYTE_LETTERS[np.frombuffer((" " + "\n ".join(some)).encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
            found = self._cut(self._lines, letters, " ", len(some))
            out += self._together(some, " ") if found is None else found
        return out

    def _known(self, words: list[str], learn) -> list[bytes]:
        """Ids of distinct words; those that aren't remembered are learnt."""
        out: list = list(map(self.get, words))
        lost = [w for w, known in zip(words, out, strict=True) if known is None]
        found = {w: known for w, known in zip(lost, map(self.older.get, lost), strict=True) if known is not None}
        new = [w for w in lost if w not in found]
        found.update(zip(new, learn(new), strict=True))
        self.update(islice(found.items(), max(0, self.size - len(self))))
        take = found.__getitem__
        return [take(w) if known is None else known for w, known in zip(words, out, strict=True)]

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of words led by a space unless they start with a line feed."""
        # a word without characters, at a text's end, is the lead alone
        found = {"": self._encode([" "])[0]} if "" in words else {}
        for lead in " \n":
            own = [w for w in words if w and (w[0] == "\n") == (lead == "\n")]
            found.update(zip(own, self._together([w.removeprefix("\n") for w in own], lead), strict=True))
        return [found[w] for w in words]

    def _ids(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct words in an order of their own, and the place of each word in it."""
        if len(self) > self.size // 2:
            self.older = dict(self)
            self.clear()
        if len(self.tails) > self.size // 8:
            self.tails = {"": b""}
        parts = pc.extract_regex(words, _LATIN)
        latin = parts.is_valid().to_numpy(zero_copy_only=False)
        parts = parts.drop_null()
        base, tail = (pc.struct_field(parts, k).dictionary_encode() for k in ("base", "tail"))
        marks = tail.dictionary.to_pylist()
        new = [m for m in marks if m not in self.tails]
        self.tails.update(zip(new, self._encode(new), strict=True))
        bases = pa.array(self._known(base.dictionary.to_pylist(), self._latin), pa.large_binary())
        tails = pa.array([self.tails[m] for m in marks], pa.large_binary())
        whole = pc.binary_join_element_wise(bases.take(base.indices), tails.take(tail.indices), pa.scalar(b"", pa.large_binary()))
        other = pa.array(self._known(words.filter(pa.array(~latin)).to_pylist(), self._others), pa.large_binary())
        return pa.concat_arrays([whole, other]), np.where(latin, np.cumsum(latin) - 1, len(whole) + np.cumsum(~latin) - 1)

    def lists(self, column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Bounds (n + 1) and ids of the texts of a string column (null: empty), with the end's ids behind each text."""
        texts = pc.fill_null(column, "")
        n = len(texts)
        whole = np.flatnonzero(_has_runs(texts)) if self._plain else np.arange(n)
        alone = texts.take(pa.array(whole)).to_pylist()
        if self._plain:
            kept = [i for i, t in enumerate(alone) if _RUN.search(t)]
            whole, alone = whole[kept], [alone[i] for i in kept]
        if len(whole):
            mark = np.zeros(n, dtype=bool)
            mark[whole] = True
            texts = pc.if_else(pa.array(mark), "", texts)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten()
        # the words that texts begin with have no lead
        heads = flat.take(pa.array(at[:-1])).to_pylist()
        for i, t in zip(whole.tolist(), alone, strict=True):
            heads[i] = t
        numbered = flat.dictionary_encode()
        codes = numbered.indices.to_numpy()
        led = np.ones(len(codes), dtype=bool)
        led[at[:-1]] = False
        used = np.zeros(len(numbered.dictionary), dtype=bool)
        used[codes[led]] = True
        own, place = self._ids(numbered.dictionary.filter(pa.array(used)))
        number = np.zeros(len(used), dtype=np.int64)
        number[used] = place
        codes = number[codes]
        codes[at[:-1]] = len(own) + np.arange(n)
        codes = np.insert(codes, at[1:], len(own) + n)
        got = pa.concat_arrays([own, pa.array([*self._encode(heads), end], pa.large_binary())]).take(pa.array(codes))
        bounds = np.frombuffer(got.buffers()[1], dtype=np.int64)[: len(codes) + 1][at + np.arange(n + 1)] // 4
        return bounds, np.frombuffer(got.buffers()[2] or b"", dtype="<i4")[: bounds[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        bounds, ids = self.lists(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in pairwise(bounds.tolist())]


def _has_runs(texts: pa.Array) -> np.ndarray:
    """Whether white space may stand before a space or line feed of a text: surely where it does, and after few other
    characters of more than one byte."""
    data, offsets = K.column_bytes(texts)
    at = np.flatnonzero((data == 32) | (data == 10))
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    at = at[_ASCII_BLANK[one] | (two == 0xC2) | (three >= 0xE1) & (three <= 0xE3)]
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


#: One cache for each tokenizer file in a Python worker, which Spark uses for many tasks.
_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHES[path] = WordCache(Tokenizer.from_file(path))
    return _CACHES[path]


def _encoder(path: str, end_id: int):
    end = np.array([end_id], dtype="<i4").tobytes()

    def run(batches):
        cache = _cache(path)
        for b in batches:
            for part in _parts(b, SLICE):
                bounds, ids = cache.lists(part.column(1), end)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(bounds), pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write (doc_id, ids, n_tokens) in ascending doc_id order over the files' names; null ids come first.

    A null or empty text has the end id only. Rows that repeat an id are all written, in the order of their texts. The
    tokenizer file is a path that every executor can read. Only the two named columns are read.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the ids fit a range of the sorted order; equal ids differ by their texts' hash, so a repeated id can be dealt out
    dealt = own.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    coded = dealt.mapInArrow(trimmed(_encoder(tokenizer, end_id)), "doc_id long, ids array<int>, n_tokens long")
    with small_batches(docs.sparkSession):
        coded.write.mode("overwrite").options(**WRITE_OPTIONS).parquet(path)


def _digests(batches):
    """Metadata and the checksum of each row's ids, taken from the list column's buffer."""
    for b in batches:
        lists = b.column(1)
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        sums = [zlib.crc32(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64()), b.column(2), b.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])


def with_starts(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Adds start: where each row's ids begin in the whole sequence, from (file, row, n_tokens).

    Totals of the files (one row each) are summed in the order of the tasks that wrote them, which is not that of the
    names beyond 100,000 tasks; within a file, a running sum follows the row order.
    """
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    bases = ws.keep(totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return run.join(sized(bases), "file").withColumn("start", F.col("base") + F.col("within"))


def read_token_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and, if asked, ids of the documents from ``first`` to ``last``, both included; null is no bound.

    Files are in doc_id order, so the bounds skip files and row groups by their statistics and pages by the page index;
    without ids, only the two narrow columns are read. Null doc_ids are given only without bounds.
    """
    rows = spark.read.schema("doc_id long, ids array<int>, n_tokens long").parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "n_tokens", *(["ids"] if ids else []))


def token_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back, and return per document doc_id, start, n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). The ids themselves are never shuffled after they are written. An empty
    table gives an empty one."""
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    path = ws.file("ids")
    write_token_ids(docs, path, tokenizer, id_col, text_col)
    body = spark.read.parquet(path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = ws.keep(body.mapInArrow(trimmed(_digests), "doc_id long, n_tokens long, ids_crc32 long, file string, row long"), "digests")
    return with_starts(rows, ws).select("doc_id", "start", "n_tokens", "ids_crc32")
