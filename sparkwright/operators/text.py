"""Corpus operators in long form: one row per (document, token, ...)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.storage import sized, stored

# fixed values: token patterns by name
TOKEN_PATTERNS = {
    "words": r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*",
    "wordsAndPunctuation": r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]",
    "whitespace": r"\S+",
    "letters": r"\p{L}+",
    "numbers": r"\p{N}+",
}


def tokens(text: Column, pattern: str = "words", fold: bool = True) -> Column:
    """array<string> of the matches of a named pattern; lower-cased first if ``fold``."""
    return F.regexp_extract_all(F.lower(text) if fold else text, F.lit(TOKEN_PATTERNS[pattern]), F.lit(0))


def long_tokens(docs: DataFrame, pattern: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token), positions from 0."""
    return docs.select(id_col, F.posexplode(tokens(F.col(text_col), pattern)).alias("pos", "token"))


def _zipped(words: Column, places: list[int], joint: str) -> Column:
    """The tokens at the given places from each token on, joined, as far as all of them exist. Shifted arrays are zipped,
    so the work is linear in the tokens."""
    last = max(places)
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words) - last, F.lit(0))).alias(f"w{k}") for k in places]
    rows = F.transform(F.arrays_zip(*shifted), lambda s: F.concat_ws(joint, *(s[f"w{k}"] for k in places)))
    return F.when(F.size(words) > last, rows).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, n: int, joint: str = " ") -> Column:
    """The n-grams of an array of tokens, joined."""
    return _zipped(words, list(range(n)), joint)


def character_ngrams(text: Column, n: int) -> Column:
    return ngrams(F.filter(F.split(text, ""), lambda c: c != ""), n, "")


def bag_of_words(docs: DataFrame, pattern: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token, n)."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col), pattern)).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def vocabulary(bag: DataFrame, min_count: int = 1, size: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(token, n, docs, id): ids by falling count, then alphabetical, from 0."""
    counts = bag.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where(F.col("n") >= min_count)
    if size is not None:
        top = counts.orderBy(F.desc("n"), "token").limit(size)
        return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1)
    # equal counts share a frame, so ids are the tokens above plus the place among equals: no sort on one task
    of_count = counts.groupBy("n").agg(F.count("*").alias("same"))
    base = of_count.select("n", (F.sum("same").over(Window.orderBy(F.desc("n"))) - F.col("same")).alias("above"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("token")) - 1
    return counts.join(F.broadcast(base), "n").select("token", "n", "docs", (F.col("above") + place).cast("int").alias("id"))


def tf_idf(bag: DataFrame, n_docs: int, id_col: str = "doc_id") -> DataFrame:
    """Smooth idf ln((1 + N) / (1 + df)) + 1, rows scaled to length 1. The bag is written once; tokens are joined by
    broadcast if their number allows."""
    bag = stored(bag, "bag")
    df = stored(bag.groupBy("token").agg(F.count("*").alias("df")), "df")
    weighted = bag.join(sized(df, 1_000_000), "token").withColumn("w", F.col("n") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
    norms = weighted.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, id_col).select(id_col, "token", (F.col("w") / F.col("norm")).alias("weight"))


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75, delta: float = 0.0, pattern: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the documents that hold a query term; idf ln(1 + (N - df + 0.5) / (df + 0.5)); ``delta`` is BM25+'s.

    Each text is read once for its length and the counts of the query's terms; only sums over all texts are exchanged.
    Texts without tokens don't count."""
    words = docs.select(id_col, tokens(F.col(text_col), pattern).alias("w"))

    def equals(term: str):
        return lambda t: t == term

    count = [F.size(F.filter("w", equals(q))).alias(f"n{i}") for i, q in enumerate(query)]
    rows = stored(words.select(id_col, F.size("w").alias("len"), *count).where("len > 0"), "bm25")
    shape = rows.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    score = F.lit(0.0)
    for i in range(len(query)):
        n, df = F.col(f"n{i}"), F.col(f"df{i}")
        part = n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("len") / F.col("mean"))) + delta
        score = score + F.when(n > 0, F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * part).otherwise(0.0)
    found = F.greatest(*(F.col(f"n{i}") for i in range(len(query))), F.lit(0)) > 0
    return rows.where(found).crossJoin(F.broadcast(shape)).select(id_col, score.alias("score"))


def cooccurrence(docs: DataFrame, window: int, keep: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n): how often b stands at most ``window`` places after a; both in the kept vocabulary (token). Partners
    are read from the token array itself, so no self-join is needed."""
    words = docs.select(id_col, tokens(F.col(text_col)).alias("w")).where(F.size("w") > 1)
    kept = sized(stored(keep.select("token"), "kept"))
    # both ends are kept before anything is counted, so a task sends at most a row for each kept pair
    left = words.select("w", F.posexplode("w").alias("i", "a")).join(kept.withColumnRenamed("token", "a"), "a")
    pairs = left.select("a", F.explode(F.slice("w", F.col("i") + 2, F.lit(window))).alias("b")).join(kept.withColumnRenamed("token", "b"), "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def shingle_overlap(docs: DataFrame, items: DataFrame, n: int, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc, item, shared, jaccard, contained) of all pairs that share an n-word shingle. The items' shingles are joined
    by broadcast if their number allows, so the documents' shingles are not shuffled but only the shared ones counted."""
    # the tokens are a column of their own, which the shingles' inner functions read but don't compute again
    cut = lambda df, key: df.select(key, tokens(F.col(text_col)).alias("w")).select(key, F.array_distinct(ngrams(F.col("w"), n)).alias("s"))
    own, of_items = cut(docs, id_col), cut(items, item_col)
    shingles = stored(of_items.select(item_col, F.size("s").alias("ni"), F.explode("s").alias("g")), "shingles")
    hits = own.select(id_col, F.size("s").alias("nd"), F.explode("s").alias("g")).join(sized(shingles, 1_000_000), "g")
    shared = hits.groupBy(id_col, item_col).agg(F.count("*").alias("shared"), F.max("nd").alias("nd"), F.max("ni").alias("ni"))
    return shared.select(id_col, item_col, "shared", (F.col("shared") / (F.col("nd") + F.col("ni") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("ni")).alias("contained"))


def pmi(pairs: DataFrame) -> DataFrame:
    """Pointwise mutual information of pair counts: pmi, positive pmi and normalised pmi, natural logarithms."""
    left = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    right = pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    total = pairs.agg(F.sum("n").alias("total"))
    p = pairs.join(left, "a").join(right, "b").crossJoin(F.broadcast(total))
    joint = F.col("n") / F.col("total")
    value = F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")).cast("double"))
    return p.select("a", "b", "n", value.alias("pmi"), F.greatest(value, F.lit(0.0)).alias("ppmi"), F.when(joint < 1, value / -F.log(joint)).otherwise(1.0).alias("npmi"))


def skip_grams(words: Column, skip: int) -> Column:
    """Pairs of tokens with at most ``skip`` tokens between them, by their distance."""
    return F.concat(*(_zipped(words, [0, d], " ") for d in range(1, skip + 2)))


@F.pandas_udf(T.StringType())
def normalise(s: pd.Series) -> pd.Series:
    """NFKC, full case folding, white space collapsed and trimmed."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


@F.pandas_udf(T.IntegerType())
def edit_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Levenshtein distance; Spark's own ``levenshtein`` is the native form, this takes token arrays."""

    def one(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


def murmur3(value: bytes, seed: int = 0) -> int:
    """32-bit MurmurHash3 (x86), signed."""
    full, h = 0xFFFFFFFF, seed
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & full
    blocks = len(value) // 4
    for k in (int.from_bytes(value[4 * i : 4 * i + 4], "little") for i in range(blocks)):
        h = (turn(h ^ turn(k * 0xCC9E2D51 & full, 15) * 0x1B873593 & full, 13) * 5 + 0xE6546B64) & full
    if rest := value[4 * blocks :]:
        h ^= turn(int.from_bytes(rest, "little") * 0xCC9E2D51 & full, 15) * 0x1B873593 & full
    h ^= len(value)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & full
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@F.pandas_udf(T.IntegerType())
def murmur_hash3(s: pd.Series) -> pd.Series:
    known: dict[str, int] = {}
    return s.map(lambda t: known.setdefault(t, murmur3(t.encode())))


def hashed_features(bag: DataFrame, dims: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, dim, value): token counts added with the sign of the hash at its absolute value modulo ``dims``."""
    h = murmur_hash3("token")
    rows = bag.withColumn("h", h)
    return rows.groupBy(id_col, (F.abs(F.col("h").cast("long")) % dims).alias("dim")).agg(F.sum(F.when(F.col("h") < 0, -F.col("n")).otherwise(F.col("n"))).alias("value"))


def split_sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re

    cut = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]*[^\W\d_a-z])")
    for s in batches:
        yield s.map(lambda t: [x.strip() for x in cut.split(t or "") if x.strip()])


sentences = F.pandas_udf(split_sentences, T.ArrayType(T.StringType()))


def _measure(stem: str) -> int:
    form = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return sum(1 for i in range(1, len(form)) if form[i - 1] == "v" and form[i] == "c")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


# fixed values: suffix rules of the published stemmer, (suffix, replacement) by step
PORTER_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
PORTER_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def porter_stem(word: str) -> str:
    """The suffix-stripping algorithm of 1980; words of at most two letters stay."""
    w = word
    if len(w) <= 2:
        return w
    vowel = lambda s: any(not _consonant(s, i) for i in range(len(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and _consonant(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and _consonant(s, len(s) - 1) and not _consonant(s, len(s) - 2) and _consonant(s, len(s) - 3) and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        elif _measure(cut) == 1 and cvc(cut):
            w = cut + "e"
        else:
            w = cut
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (PORTER_2, PORTER_3):
        for rule in sorted(rules.split(), key=lambda r: -len(r.split(":")[0])):
            end, new = rule.split(":")
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(PORTER_4.split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(s: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return s.map(lambda t: known[t] if t in known else known.setdefault(t, porter_stem(t)))
