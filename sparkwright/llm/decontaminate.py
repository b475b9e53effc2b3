"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask keeps some of ``SPAN`` consecutive word positions and ignores the rest, so a window still hashes alike after
words at ignored positions were replaced. Seeds of all benchmark windows are joined with the seeds of all corpus
windows; around each hit, the item is laid over the text and equal words are found. An alignment counts if it reaches
the coverage alone, or if some ``RUN`` consecutive words of the item have ``RUN_EQUAL`` equal ones. The positions of an
item that some counted alignment matches, over its length, are its coverage.

The masks are all ways to keep 3 of 5 places. If no 5 consecutive places of an item of n = 5 q + r words had 3 equal
words, at most 2 q + min(r, 2) were equal, which is less than 0.6 n for every n from 5; so each alignment with a
coverage of 0.6 is hit, wherever its words were replaced. 8 equal words of 12 are hit for the same reason. Items of
fewer than SPAN words have a seed of all their words, and are found where all of them stand.

The corpus is never shuffled: words, windows, seeds, the join with the (size-checked) seed table and the alignment run
in one stage. What is done for hits alone is in functions of arrays, which are not compiled into that stage's loop, as
the Java compiler leaves loops alone that are too long. Only alignments that count are aggregated. A benchmark too large
to broadcast is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.workspace import Workspace, sized

#: All masks of weight 3 over up to 5 words; 1 is compared, 0 ignored.
MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
SPAN = 5
#: Parts of an item count from so many equal words of so many.
RUN, RUN_EQUAL = 12, 8
#: Words of one segment of a text; segments overlap by the longest item, so each alignment lies whole in one.
SEGMENT = 2048
#: Seed rows up to which the seed table is broadcast (about 24 bytes each).
SEED_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seed(mask: str, at: list[Column], number: int) -> Column:
    kept = [c for bit, c in zip(mask, at, strict=False) if bit == "1"]
    return F.when(at[len(mask) - 1].isNotNull(), F.xxhash64(F.lit(number), *kept))


def _shape(mask: str) -> int:
    """The places of a mask's second and third word as one number; 0 for the seed of a short item."""
    kept = [k for k, bit in enumerate(mask) if bit == "1"]
    return 10 * kept[1] + kept[2] if mask in MASKS else 0


def _windows(df: DataFrame, array: str, keep: list[str], masks: list[tuple[int, str]]) -> DataFrame:
    """One row per window and mask: pos (from 0), the mask's number and seed. ``array`` holds the words of a segment."""
    names = [f"w{k}" for k in range(SPAN)]
    shifted = [F.slice(F.col(array), F.lit(k + 1), F.size(array)).alias(names[k]) for k in range(SPAN)]
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "win"))
    at = [F.col("win")[n] for n in names]
    seeds = F.array(*(_seed(m, at, number) for number, m in masks))
    return rows.select(*keep, "pos", F.explode(seeds).alias("seed")).where("seed is not null")


def _seeds(ws: Workspace, items: DataFrame) -> tuple[DataFrame, list[tuple[int, str]]]:
    """(seed, item, len, ipos, shape) of the items, and the numbered masks in use: an item of fewer than SPAN words has that
    of its length."""
    short = sorted(r["len"] for r in items.where((F.col("len") > 0) & (F.col("len") < SPAN)).select("len").distinct().collect())
    masks = [(n, "1" * n) for n in short] + [(_shape(m), m) for m in MASKS]
    found = None
    for number, mask in masks:
        own = items.where(F.col("len") == len(mask)) if number < SPAN else items.where(F.col("len") >= SPAN)
        # a seed that an item repeats keeps all its places: each is another alignment
        more = _windows(own, "words", ["item", "len"], [(number, mask)]).select("seed", "item", "len", F.col("pos").alias("ipos"), F.lit(number if number >= SPAN else 0).alias("shape"))
        found = more if found is None else found.unionByName(more)
    return ws.keep(found, "seeds"), masks


def _first(t: Column) -> Column:
    """Whether a hit is the first of its dense stretch of equal words: its mask keeps the first three of them, and none
    before them makes a hit with its first two. Each alignment with a hit has one like this, and a copy only one."""
    near = F.array(*(F.lit(j) for j in range(1 - SPAN, SPAN)))
    same = F.filter(near, lambda j: F.get(t["under"], t["ipos"] - t["skip"] + j) == F.get(t["words"], t["ipos"] + j))

    def judged(m: Column) -> Column:
        after = F.transform(F.array(F.filter(m, lambda j: j >= 0)), lambda a: F.struct(F.get(a, F.lit(1)).alias("s"), F.get(a, F.lit(2)).alias("t")))
        return F.exists(after, lambda a: (10 * a["s"] + a["t"] == t["shape"]) & ~F.exists(m, lambda j: (j < 0) & (a["s"] - j < SPAN)))

    return (t["shape"] == 0) | F.coalesce(F.transform(F.array(same), judged)[0], F.lit(False))


def _matched(hit: Column, coverage: float) -> Column:
    """The item's places that a hit's alignment matches; null if they don't count or the hit is not the first. A hit has
    under (the text's words from the item's place ``skip`` on), skip, words, len, ipos and shape. Each transform of one
    element binds a value, so that no inner function computes it again."""

    def equal(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(t["under"]) - 1, F.lit(0)))
        same = F.filter(places, lambda k: (k + t["skip"] < t["len"]) & (F.get(t["under"], k) == F.get(t["words"], k + t["skip"])))
        return F.struct(F.transform(same, lambda k: k + t["skip"]).alias("at"), t["len"].alias("len"))

    laid = F.transform(F.filter(F.array(hit), _first), equal)
    return F.get(F.transform(laid, lambda t: F.when(_counts(t["at"], t["len"], coverage), t["at"])), F.lit(0))


def _counts(equal: Column, n: Column, coverage: float) -> Column:
    """Whether the equal places of an alignment are enough of the item, or RUN_EQUAL of some RUN consecutive ones."""
    last = F.size(equal) - RUN_EQUAL
    run = F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.get(equal, k + RUN_EQUAL - 1) - F.get(equal, k) < RUN)
    enough = F.size(equal) >= F.when(n < SPAN, n).otherwise(F.ceil(n * F.lit(coverage) - 1e-9))
    return enough | ((last >= 0) & F.coalesce(run, F.lit(False)))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    coverage: float = 0.6,
) -> DataFrame:
    """Pairs of a text and a benchmark item that covers at least ``coverage`` of the item's words.

    Returns doc id, item id, matched (distinct item positions that alignments around hits match), item_words, coverage
    (rounded to 6 places); one row per pair, clean texts have none. Words are lower-case runs of letters and digits.
    Every item of at least 5 words that some alignment covers to ``coverage`` is found, for any coverage from 0.6; below
    that, alignments without 3 equal words of 5 consecutive ones are missed. Pieces of an item at several places of a
    text (after words were put in or left out) add up if each has 8 equal words of 12. Items of 1 to 4 words are found
    only whole; null ones, and those without words, never. Null or empty texts and null ids match nothing; rows that
    repeat an id are one document, rows that repeat an item one item. Only the named columns are read. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), words(F.col(item_text_col)).alias("words")).where("item is not null").distinct()
    items = ws.keep(items.withColumn("len", F.size("words")).where("len > 0"), "items")
    longest = items.agg(F.max("len")).first()[0] or 0
    seeds, masks = _seeds(ws, items)
    split = docs.select(F.col(id_col).cast("long").alias("doc"), words(F.col(text_col)).alias("all")).where("doc is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(SEGMENT))
    parts = split.select("doc", "all", F.explode(starts).alias("start")).select("doc", F.slice("all", F.col("start") + 1, F.lit(SEGMENT + longest + SPAN)).alias("part"))
    hits = _windows(parts, "part", ["doc", "part"], masks).join(sized(seeds, SEED_ROWS), "seed")
    # of the text, a hit carries on only what lies under its item
    begin = F.col("pos") - F.col("ipos")
    laid = hits.select("doc", "item", "len", "ipos", "shape", F.greatest(-begin, F.lit(0)).alias("skip"), F.slice("part", F.greatest(begin, F.lit(0)) + 1, F.col("len")).alias("under"))
    laid = laid.join(sized(items.select("item", "words"), SEED_ROWS // 10), "item")
    hit = F.struct(*(F.col(c) for c in ("under", "skip", "words", "len", "ipos", "shape")))
    # an outer explode, as an inner one would have its array computed twice, once to see whether it is empty
    places = laid.select("doc", "item", "len", F.explode_outer(_matched(hit, coverage)).alias("place")).where("place is not null").distinct()
    pairs = places.groupBy("doc", "item").agg(F.count("*").alias("matched"), F.max("len").cast("long").alias("item_words"))
    share = F.col("matched") / F.col("item_words")
    return pairs.where(F.when(F.col("item_words") < SPAN, share >= 1).otherwise(share >= coverage)).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "matched", "item_words", F.round(share, 6).alias("coverage"))
