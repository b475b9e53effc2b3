"""Running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the order is cut into.
RANGES = 64


def running_totals(df: DataFrame, order: str, values: list[str], descending: bool = False, then: list[str] | None = None) -> DataFrame:
    """Adds upto_<value>: the sum of each value over the rows up to and with this one in the given order, ties included.

    ``df`` has one row per value of ``order``, or else equal values share their total; with columns ``then``, rows of equal
    values are put in their rising order (nulls last) and added one by one. Quantiles of a numeric order (or
    sampled ones of another) cut the table into ranges; each range is summed by itself, and the totals of the ranges
    before it, of which there are at most RANGES, are added. Nulls of the order come last.
    """
    kind = dict(df.dtypes)[order]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        cuts = sorted(set(df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
        at = F.col(order).cast("double")
    else:
        few = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(8 * RANGES).collect()
        cuts = sorted({r[0] for r in few})[::8]
        at = F.col(order)
    place = F.lit(0)
    for c in cuts:
        place = place + F.when(at > F.lit(c), 1).otherwise(0)
    place = F.when(F.col(order).isNull(), (-1 if descending else 1) * (len(cuts) + 1)).otherwise(place)
    cut = df.withColumn("_range", -place if descending else place)
    sums = cut.groupBy("_range").agg(*(F.sum(v).alias(f"_all_{v}") for v in values))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows
    bases = sums.select(F.col("_range"), *(F.coalesce(F.sum(f"_all_{v}").over(before), F.lit(0)).alias(f"_base_{v}") for v in values))
    own = Window.partitionBy("_range").orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last())
    if then:
        own = own.orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in then)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.withColumns({f"_own_{v}": F.sum(v).over(own) for v in values})
    return run.join(F.broadcast(bases), "_range").select(*df.columns, *((F.col(f"_own_{v}") + F.col(f"_base_{v}")).alias(f"upto_{v}") for v in values))
