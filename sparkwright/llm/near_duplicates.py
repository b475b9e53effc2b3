"""b-bit MinHash near-duplicate groups.

Texts with equal shingle sets form a class first, so thousands of copies cost one row. Each class gets minima in bands
of ``ROWS``; equal bands give candidate buckets, the low ``BITS`` bits of every mixed minimum are packed into longs, and
the collision-corrected similarity of a candidate pair comes from bit counts. Pairs above a generous bound are
confirmed on the full sets, so the estimate only saves work.

A bucket never emits all its pairs. In each of a few rounds a row meets one pivot: of the pivots of its buckets that are
not in its component, the one with which it shares most buckets. Links are contracted to components, and only buckets
that still hold more than one component stay. At the end, the rows of different components of such a bucket are
compared with each other in blocks: first by the bit counts of longer signatures, which gives the rows that have a
likely partner, then those by their full sets. Pairs are compared inside a task, which returns rows or a forest of
links, so no table has a row for each pair. The estimate has a margin of five standard errors, so a pair at the bound is
lost with probability 3e-7; no other pair of a bucket is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm import components
from sparkwright.llm import textkernel as K
from sparkwright.llm.workspace import Workspace, trimmed

#: Minima of a band, and bits kept of a minimum.
ROWS, BITS = 4, 2
#: A pair at the similarity bound shares no band with at most this probability; that sets the number of bands.
MISSED = 1e-6
#: A row meets one pivot in each of this many rounds, before all that is left is compared.
PIVOT_ROUNDS = 2
#: Minima of the longer signatures of the few texts that are still open at the end.
FINE = 1024
#: Rows of a block of a bucket that is compared by signatures, and by full sets; shingles that are looked up at once.
BLOCK, WHOLE_BLOCK, LOOKED_UP = 256, 64, 1 << 20
_PAIRS = 0x5555555555555555

_SEED = K.mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_A = (_SEED[:FINE] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEED[FINE:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, words: int):
    """For every text its sorted distinct shingle hashes; fewer words than a shingle make one shingle, none make none."""
    U = np.uint64
    docs, h = K.word_hashes(column)
    n = len(column)
    counts = np.bincount(docs, minlength=n)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        if len(h) >= words:
            value = np.zeros(len(h) - words + 1, dtype=U)
            for k in range(words):
                value = K.mix(value * U(3) + h[k : len(h) - words + 1 + k] + U(k + 1))
        for i in range(n):
            m, end = int(counts[i]), int(ends[i])
            if m >= words:
                yield np.unique(value[end - m : end - words + 1])
            elif m:
                short = np.zeros(1, dtype=U)
                for k in range(end - m, end):
                    short = K.mix(short * U(3) + h[k] + U(1 + k - end + m))
                yield K.mix(short + U(m))
            else:
                yield np.zeros(0, dtype=U)


def bands_for(percent: int) -> int:
    """Bands (a multiple of 8, so that minima fill longs) that keep the chance of missing a pair at the bound below MISSED."""
    fewest = math.log(MISSED) / math.log1p(-min((percent / 100) ** ROWS, 1 - 1e-9))
    return min(FINE // ROWS, 8 * max(1, math.ceil(fewest / 8)))


def minima(own: np.ndarray, hashes: int) -> np.ndarray:
    """The minimum of each of the first so many hash functions over a set."""
    low = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    a, b = _A[:hashes, None], _B[:hashes, None]
    for at in range(0, len(low), 1024):
        out = np.minimum(out, (a * low[None, at : at + 1024] + b).min(axis=1))
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = K.mix(key * np.uint64(3) + rows[:, r])
    return key.view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The two low bits of every mixed minimum, in longs."""
    low = (K.mix(m.astype(np.uint64)) & np.uint64(3)).astype(np.uint64).reshape(-1, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def _signatures(words: int, hashes: int):
    def run(batches):
        for b in batches:
            ids, out = b.column(0), {k: [] for k in ("n", "d1", "d2", "bands")}
            with np.errstate(over="ignore"):
                for own in shingle_sets(b.column(1), words):
                    out["n"].append(len(own))
                    out["d1"].append(np.sum(K.mix(own + np.uint64(11)), dtype=np.uint64))
                    out["d2"].append(np.sum(K.mix(own * np.uint64(5) + np.uint64(7)), dtype=np.uint64))
                    out["bands"].append(band_keys(minima(own, hashes)) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out["n"], pa.int64()), *(pa.array(np.array(out[k], dtype=np.uint64).view(np.int64)) for k in ("d1", "d2")), pa.array(out["bands"], pa.list_(pa.int64()))],
                names=["id", "n", "d1", "d2", "bands"],
            )

    return run


def _sets(words: int, hashes: int):
    def run(batches):
        for b in batches:
            own = list(shingle_sets(b.column(1), words))
            bits = [packed_bits(minima(x, hashes)) if len(x) else None for x in own]
            sizes = pa.array([len(x) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(bits, pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["id", "n", "bits", "set"])

    return run


def _fine(batches):
    for b in batches:
        bits = [packed_bits(minima(np.asarray(x.values, dtype=np.int64).view(np.uint64), FINE)) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.list_(pa.int64())), b.column(2)], names=["id", "n", "bits", "set"])


class _Block:
    """Rows of a bucket as arrays: ids, components, set sizes, signatures, the rows' bands and, if given, their sets."""

    def __init__(self, ids, comps, sizes, bits, counts, bands, sets=None):
        self.ids, self.comps, self.sizes = ids, comps, sizes
        self.bits = bits.view(np.uint64).reshape(len(ids), -1)
        self.band, self.row = bands, np.repeat(np.arange(len(ids)), counts)
        self.sets = None if sets is None else np.split(sets.view(np.uint64), np.cumsum(sizes)[:-1])


def _likely(a: _Block, b: _Block, band: int, percent: int):
    """(row of a, rows of b): pairs of different components that pass the bounds of sizes and estimate and share no
    smaller band, in which they are met. With itself, a block's pairs are met once."""
    open_ = (a.comps[:, None] != b.comps) & (100 * np.minimum(a.sizes[:, None], b.sizes) >= percent * np.maximum(a.sizes[:, None], b.sizes))
    if a is b:
        open_ &= np.tri(len(a.ids), k=-1, dtype=bool).T
    if not open_.any():
        return
    sooner = np.intersect1d(a.band[a.band < band], b.band[b.band < band])
    if len(sooner):
        sides = []
        for x in (a, b):
            at = np.minimum(np.searchsorted(sooner, x.band), len(sooner) - 1)
            in_ = sooner[at] == x.band
            side = np.zeros((len(x.ids), len(sooner)), dtype=np.float32)
            side[x.row[in_], at[in_]] = 1
            sides.append(side)
        open_ &= sides[0] @ sides[1].T == 0
    chance, least = 1.0 / 2**BITS, margin(percent, FINE)
    for i in np.flatnonzero(open_.any(axis=1)):
        j = np.flatnonzero(open_[i])
        x = a.bits[i] ^ b.bits[j]
        unequal = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_PAIRS)).sum(axis=1, dtype=np.int64)
        j = j[((1.0 - unequal / FINE) - chance) / (1.0 - chance) >= least]
        if len(j):
            yield i, j


def _links(a: _Block, b: _Block, band: int, percent: int):
    """A forest of the links between the components of two blocks, confirmed on the full sets."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.setdefault(c, c) != c:
            up[c] = c = up[up[c]]
        return c

    for i, all_j in _likely(a, b, band, percent):
        own, ends = a.sets[i], np.cumsum(b.sizes[all_j])
        for j in np.split(all_j, np.flatnonzero(np.diff(ends // LOOKED_UP)) + 1):
            j = [k for k in j if root(int(a.comps[i])) != root(int(b.comps[k]))]
            if not j:
                continue
            flat = np.concatenate([b.sets[k] for k in j])
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            shared = np.add.reduceat(found.astype(np.int64), np.cumsum([0, *(len(b.sets[k]) for k in j[:-1])]))
            for k, n in zip(j, shared, strict=True):
                ca, cb = root(int(a.comps[i])), root(int(b.comps[k]))
                if ca != cb and 100 * n >= percent * (len(own) + len(b.sets[k]) - n):
                    up[ca] = cb
                    yield int(a.ids[i]), int(b.ids[k])


def _compared(percent: int, whole: bool):
    """Over rows of (band, a block, another block or nulls): the (band, id) of rows with a likely partner, or links (a, b)."""
    width = 7 if whole else 6

    def run(batches):
        for t in batches:
            left, right = [], []
            for i in range(t.num_rows):
                band = t.column(0)[i].as_py()
                side = lambda at: _Block(*(np.asarray(t.column(at + k)[i].values, dtype=np.int64) for k in range(width)))  # noqa: B023, E731
                a = side(1)
                b = side(1 + width) if t.column(1 + width)[i].is_valid else a
                if whole:
                    pairs = list(_links(a, b, band, percent))
                    left += [p[0] for p in pairs]
                    right += [p[1] for p in pairs]
                else:
                    near = {int(x) for i, j in _likely(a, b, band, percent) for x in (a.ids[i], *b.ids[j])}
                    left += [band] * len(near)
                    right += near
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"] if whole else ["band", "id"])

    return run


def margin(percent: int, hashes: int) -> float:
    """The similarity bound less five standard errors of the estimate at the bound."""
    chance = 1.0 / 2**BITS
    same = chance + (1 - chance) * percent / 100
    return percent / 100 - 5 * (same * (1 - same) / hashes) ** 0.5 / (1 - chance)


def estimated(a: Column, b: Column, hashes: int) -> Column:
    """Collision-corrected similarity of two packed signatures: (share of equal lanes - 2^-b) / (1 - 2^-b)."""
    unequal = None
    for k in range(hashes * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        x = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIRS)))
        unequal = x if unequal is None else unequal + x
    chance = 1.0 / 2**BITS
    return ((1.0 - unequal / F.lit(float(hashes))) - chance) / (1.0 - chance)


def _alike(a: Column, b: Column, na: Column, nb: Column, hashes: int, percent: int) -> Column:
    """Whether sizes and the estimate leave open that two sets reach the similarity."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (estimated(a, b, hashes) >= margin(percent, hashes))


def _confirmed(ws: Workspace, pairs: DataFrame, sets: DataFrame, hashes: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. Sets are read only for pairs that pass the estimate. All
    joins are on written tables, so skewed keys are split."""
    narrow = lambda side: sets.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}"))
    near = pairs.join(narrow("a"), "a").join(narrow("b"), "b").where(_alike(F.col("bitsa"), F.col("bitsb"), F.col("na"), F.col("nb"), hashes, percent))
    near = ws.keep(near.select("a", "b"), f"near-{name}")
    whole = lambda side: sets.select(F.col("id").alias(side), F.col("set").alias(f"s{side}"))
    both = near.join(whole("a"), "a").join(whole("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - shared
    return ws.keep(both.where(100 * shared >= percent * union).select("a", "b"), f"links-{name}")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Components of texts whose word-shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns one row per input row: id, n_shingles (set size), component_id (smallest id reachable by links, itself
    included), kept (id = component_id). Words are runs of non-space bytes, A-Z lower-cased; a text with fewer words
    than a shingle has its whole word sequence as the one shingle. Null, empty and blank texts have an empty set and no
    links. Rows that repeat an id are one document: they share their component. A null id gets a null component and is
    kept. Only the two named columns are read, so other columns may have any names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "neardup")
    hashes = ROWS * bands_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = ws.keep(texts.mapInArrow(trimmed(_signatures(words, hashes)), "id long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    key = ["n", "d1", "d2"]
    # distinct sets; the smallest id stands for each
    classes = ws.keep(seen.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep")), "classes")
    shown = seen.join(classes.select(F.col("rep").alias("id"), *(F.col(c).alias(f"k_{c}") for c in key)), "id").where(" and ".join(f"{c} = k_{c}" for c in key))
    entries = shown.select("id", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band")
    members = ws.keep(entries.join(ws.keep(buckets, "buckets"), "band").distinct(), "members")
    wanted = ws.keep(members.select("id").distinct(), "wanted")
    # full sets only of texts that share a band with another; rows that repeat an id are one document of all their shingles
    made = wanted.join(texts, "id").mapInArrow(trimmed(_sets(words, hashes)), "id long, n long, bits array<long>, set array<long>")
    sets = ws.keep(made, "sets")
    links, labels = None, None
    for turn in range(PIVOT_ROUNDS):
        if not (met := _pivot_pairs(ws, members, labels, turn)):
            break
        links, labels = _linked(ws, links, labels, _confirmed(ws, met, sets, hashes, percent, f"round{turn}"), f"round{turn}")
        members = _open(ws, members, labels, f"round{turn}")
    if not members.isEmpty():
        new = _rest(ws, members, labels, sets, percent)
        links, labels = _linked(ws, links, labels, new, "rest")
    found = _labelled(classes, labels, "rep", "component_id") if labels is not None else classes.withColumn("component_id", F.col("rep"))
    out = seen.select("id", *key).join(ws.keep(found.select(*key, "component_id"), "found"), key, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """The component of a node; a node without links is its own."""
    known = labels.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def _linked(ws: Workspace, links: DataFrame | None, labels: DataFrame | None, new: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All links so far and the components that they make."""
    if links is not None and new.isEmpty():
        return links, labels
    links = new if links is None else links.unionByName(new)
    return links, components.component_labels(ws, links, name)


def _pivot_pairs(ws: Workspace, members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame | None:
    """At most one pair (a, b) for each row: with that pivot of another component with which it shares most buckets.

    The order that chooses a bucket's pivot is the same in all buckets of a round, so alike rows meet few pivots."""
    if members.isEmpty():
        return None
    order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    pivots = ws.keep(members.groupBy("band").agg(F.min_by("id", order).alias("pivot")), f"pivots{turn}")
    met = members.join(pivots, "band").where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("bands"))
    if labels is not None:
        met = _labelled(_labelled(ws.keep(met, f"met{turn}"), labels, "id", "ca"), labels, "pivot", "cb").where("ca <> cb")
    one = met.groupBy("id").agg(F.max_by("pivot", F.struct("bands", -F.col("pivot"))).alias("pivot"))
    return ws.keep(one.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), f"pairs{turn}")


def _open(ws: Workspace, members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The members of the buckets that hold more than one component."""
    mixed = ws.keep(_labelled(members, labels, "id", "comp"), f"mixed-{name}")
    still = mixed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    return ws.keep(mixed.join(ws.keep(still, f"open-{name}"), "band").select("band", "id"), f"members-{name}")


def _rest(ws: Workspace, members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all components of each bucket that have a link in it."""
    fine = ws.keep(members.select("id").distinct().join(sets.select("id", "n", "set"), "id").mapInArrow(trimmed(_fine), "id long, n long, bits array<long>, set array<long>"), "fine")
    bands = ws.keep(members.groupBy("id").agg(F.collect_set("band").alias("bands")), "bands")  # at most one of each band
    known = ws.keep(_labelled(members, labels, "id", "comp"), "rest")
    near = _blocks(ws, known, bands, fine, False).mapInArrow(trimmed(_compared(percent, False)), "band long, id long")
    near = ws.keep(near.distinct(), "near-rest")
    likely = ws.keep(known.join(near, ["band", "id"]), "likely")
    return ws.keep(_blocks(ws, likely, bands, fine, True).mapInArrow(trimmed(_compared(percent, True)), "a long, b long").distinct(), "links-rest")


def _blocks(ws: Workspace, known: DataFrame, bands: DataFrame, fine: DataFrame, whole: bool) -> DataFrame:
    """The rows (band, id, comp) of each bucket in blocks, every two blocks of a bucket once; nulls where a block meets
    itself. A large bucket's blocks spread over the tasks."""
    name = "whole" if whole else "bits"
    counts = known.groupBy("band").agg(F.ceil(F.count("*") / F.lit(WHOLE_BLOCK if whole else BLOCK)).cast("int").alias("blocks"))
    rows = known.join(ws.keep(counts, f"counts-{name}"), "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = ws.keep(rows, f"dealt-{name}").join(bands, "id").join(fine if whole else fine.drop("set"), "id")
    entry = F.struct("id", "comp", "n", "bits", "bands", *(["set"] if whole else []))
    packed = rows.groupBy("band", "block", "blocks").agg(F.collect_list(entry).alias("r"))
    lists = {"ids": F.col("r.id"), "comps": F.col("r.comp"), "sizes": F.col("r.n"), "bits": F.flatten("r.bits"), "counts": F.transform("r.bands", lambda x: F.size(x).cast("long")), "bands": F.flatten("r.bands")} | ({"sets": F.flatten("r.set")} if whole else {})
    packed = ws.keep(packed.select("band", "block", "blocks", *(c.alias(n) for n, c in lists.items())), f"packed-{name}")
    other = packed.select("band", F.col("block").alias("other"), *(F.col(n).alias(f"other_{n}") for n in lists))
    several = packed.where("block + 1 < blocks").withColumn("other", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    columns = ["band", *lists, *(f"other_{n}" for n in lists)]
    alone = packed.select("band", *lists, *(F.lit(None).cast("array<long>").alias(f"other_{n}") for n in lists))
    return alone.unionByName(several.join(other, ["band", "other"]).select(*columns))
