"""Exact top-k inner products with KD-trees per shard.

Vectors become integers, floor(scale * x), and are dealt into shards. Each shard is a KD-tree: median splits on the
widest side, leaves of ``LEAF`` vectors, and a tight bounding box per node. The inner product of a query with anything
in a box is at most sum_j max(q_j * low_j, q_j * high_j). Traversal takes the nodes in the order of that bound and
stops at the query's kth best score; boxes that tie with it are still opened, so ties are exact.

Shards are searched in rounds of 1, 2, 4, ... shards. After each round the best k rows of every query so far are
merged, and the kth score goes on to the next round, so later shards open few boxes and return few rows. A task holds
one tree and one block of queries: each block meets each shard once, which costs SHARD products for every component
sent. No task or driver holds more than a shard and a block.

All scores and bounds are exact integers. Where a proven bound on them is below 2 ** 53 they are held in doubles, below
2 ** 63 in longs, and else in Python's integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.workspace import Workspace

#: Vectors of a shard (about), of a leaf; queries of a block.
SHARD, LEAF, BLOCK = 16384, 128, 1024
#: The range of the scores that are returned.
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def exact_type(x: np.ndarray, queries: np.ndarray) -> type:
    """A type that holds all inner products of rows of the two integer matrices, and all bounds, exactly."""
    most = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    largest = most(x) * most(queries) * max(1, queries.shape[1]) * 2
    return np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object


def in_range(score: np.ndarray) -> np.ndarray:
    """Exact scores as longs; those of Python's integers stop at the range."""
    if score.dtype == object:
        score = np.array([min(max(v, LOWEST), HIGHEST) for v in score], dtype=np.int64)
    return score.astype(np.int64)


class KdTree:
    """Nodes in arrays: boxes, children (-1 for a leaf) and row ranges of the reordered vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.low, self.high, self.left, self.right, self.span = [], [], [], [], []
        self._x, self._leaf = x, leaf
        if len(x):
            self._build(0, len(x))
        self.ids, self.rows, self.x = ids[self.order], rows[self.order], x[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, lo: int, hi: int) -> int:
        stack = [(lo, hi, -1, False)]
        while stack:
            lo, hi, parent, right = stack.pop()
            own = self._x[self.order[lo:hi]]
            node = len(self.span)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.left.append(-1)
            self.right.append(-1)
            self.span.append((lo, hi))
            if parent >= 0:
                (self.right if right else self.left)[parent] = node
            width = self.high[node].astype(np.float64) - self.low[node]  # which side is widest needs no exactness
            side = int(np.argmax(width))
            if hi - lo > self._leaf and width[side] > 0:
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, side], mid)]
                stack.append((lo, lo + mid, node, False))
                stack.append((lo + mid, hi, node, True))
        return 0

    def widen(self, dim: int) -> None:
        """Zeros after each vector, up to so many components."""
        more = dim - self.x.shape[1]
        if more > 0:
            pad = lambda m: np.pad(m.reshape(-1, self.x.shape[1]), ((0, 0), (0, more)))
            self.low, self.high, self.x = pad(self.low), pad(self.high), pad(self.x)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all inner products, queries x nodes, in the type of the queries."""
        high, low = self.high.astype(queries.dtype), self.low.astype(queries.dtype)
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int, reached: list[int | None]):
        """(query index, rows, scores) of the best k of this shard at or above ``reached``, best first, ties by id and
        row. ``rows`` are places in the shard; a query's own row (of ``query_rows``) is left out."""
        if not len(self.x):
            return
        kind = exact_type(self.x, queries)
        x, queries = self.x.astype(kind), queries.astype(kind)
        bounds = self.bounds(queries)
        for q in range(len(queries)):
            kth = reached[q]
            at, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            heap = [(-bounds[q, 0], 0)]
            while heap and (kth is None or -heap[0][0] >= kth):
                _, node = heapq.heappop(heap)
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if kth is None or bounds[q, child] >= kth:
                            heapq.heappush(heap, (-bounds[q, child], child))
                    continue
                lo, hi = self.span[node]
                score = in_range(x[lo:hi] @ queries[q])
                keep = self.rows[lo:hi] != query_rows[q]
                if kth is not None:
                    keep &= score >= kth
                if not keep.any():
                    continue
                best, at = np.concatenate([best, score[keep]]), np.concatenate([at, np.flatnonzero(keep) + lo])
                if len(best) > k:
                    top = np.lexsort((self.rows[at], self.ids[at], ~best))[:k]
                    best, at = best[top], at[top]
                if len(best) >= k:
                    kth = int(best.min()) if kth is None else max(kth, int(best.min()))
            top = np.lexsort((self.rows[at], self.ids[at], ~best))[:k]
            if len(top):
                yield q, at[top], best[top]


def _unpacked(body: pa.Scalar, sizes: pa.Scalar) -> np.ndarray:
    """The vectors of a row as a matrix of longs; shorter ones end in zeros."""
    size = np.asarray(sizes.values, dtype=np.int64)
    flat = np.asarray(body.values, dtype=np.int64)
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def _packed(df: DataFrame, key: str, *more: str) -> DataFrame:
    """One row per key: ids, rows, the vectors one after the other and their sizes, in the order of the rows."""
    own = F.sort_array(F.collect_list(F.struct("row", "id", "v", *more)))
    return df.groupBy(key).agg(own.alias("r")).select(key, F.col("r.id").alias("ids"), F.col("r.row").alias("rows"), F.flatten("r.v").alias("body"), F.transform("r.v", F.size).alias("sizes"), *(F.col(f"r.{c}").alias(c) for c in more))


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "query_row", "vec_id", "row", "score")])


def _search(k: int):
    """Batches of shard, ids, rows, body, sizes and of the block ids, rows, body, sizes, reached."""

    def run(batches):
        shard, tree = None, None
        for b in batches:
            for i in range(b.num_rows):
                c = [b.column(j)[i] for j in range(b.num_columns)]
                whole = lambda j: np.asarray(c[j].values, dtype=np.int64)  # noqa: B023, E731
                if c[0].as_py() != shard:
                    shard = c[0].as_py()
                    tree = KdTree(whole(1), whole(2), _unpacked(c[3], c[4]))
                ids, rows, queries = whole(5), whole(6), _unpacked(c[7], c[8])
                # a component that only one side has meets zeros
                dim = max(queries.shape[1], tree.x.shape[1])
                tree.widen(dim)
                queries = np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
                out = list(tree.search(rows, queries, k, c[9].as_py()))
                q = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)
                at = np.concatenate([np.zeros(0, dtype=np.int64), *(o[1] for o in out)])
                score = np.concatenate([np.zeros(0, dtype=np.int64), *(o[2] for o in out)])
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids[q], rows[q], tree.ids[at], tree.rows[at], score)], names=_FOUND.names)

    return run


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best other rows of ``vectors`` by integer inner product for every row whose id ``queries`` has, exactly.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer than k rows if there are fewer
    candidates. Components become floor(scale * x), with x as double, and stop at the range of longs; so do scores. Rows
    with a null id, a null vector, or a null or non-finite component take no part. Rows that repeat an id are rows of
    their own, as queries and as candidates. A vector that is shorter than another counts as if zeros followed; zero and
    empty vectors take part with score 0. Other columns are not read. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "search")
    x = F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("x")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), x).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # scaling may pass the range of doubles, whose floor is the end of the range of longs
    clean = own.where(F.coalesce(finite, F.lit(False))).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    rows = ws.keep(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    asked = ws.keep(rows.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi"), "asked")
    n_blocks, n_shards = max(1, -(-asked.count() // BLOCK)), max(1, -(-n // SHARD))
    shards = ws.keep(_packed(rows.withColumn("shard", F.pmod(F.xxhash64("row", F.lit("shard")), F.lit(n_shards))), "shard"), "shards")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best, at, step = None, 0, 1
    while at < n_shards:
        reached = asked.withColumn("reached", F.lit(None).cast("long"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("reached"))
            reached = asked.join(kth, "row", "left")
        blocks = ws.keep(_packed(reached, "block", "reached"), f"blocks{at}")
        names = ("ids", "rows", "body", "sizes", "reached")
        # every block visits every shard of the round
        visits = blocks.select(F.explode(F.sequence(F.lit(at), F.lit(min(at + step, n_shards) - 1)).cast("array<long>")).alias("shard"), *(F.col(c).alias(f"q_{c}") for c in names))
        met = shards.where(F.col("shard").between(at, at + step - 1)).join(visits, "shard")
        found = met.select("shard", *names[:4], *(f"q_{c}" for c in names)).mapInArrow(_search(k), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = ws.keep(found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k), f"best{at}")
        at, step = at + step, 2 * step
    return best.select("query_id", "rank", "vec_id", "score")
