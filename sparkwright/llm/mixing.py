"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

The rates r of documents minimise the entropy sum of r * ln(r) - r under one token constraint per source,
sum(size * r) = target, and 0 <= r <= 2. The solution is an exponential tilt, r = min(2, exp(lambda * size)), with one
dual variable per source. The dual is concave; distributed Newton steps solve it for all sources at once over the
(source, size, count) table, which holds a row per distinct size of a source, however many documents it has. Steps that
leave the bracket known to hold the root are replaced by bisection.

Rates are rounded to copies with a keyed hash of the id: a document takes floor(r) copies, and one more if its hash is
below the fractional part plus a shift of its source. The shift is chosen by counting, so that the words taken come as
near to the target as one document allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.workspace import Workspace, sized

#: Words in a text: runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken at most so often; a source's target is at most so many times its size.
CAP = 2.0
#: Newton steps; with bisection as the fallback, so many always reach the tolerance.
STEPS = 60
TOLERANCE = 1e-7
#: Cells per source of the rounding table; a cell is refined to single documents only where the target falls.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """Targets of the sources (source, source_size): weights repeat in code-point order (null last), the targets share
    ``share`` times all sizes in proportion, none above twice its source's size; the excess is reshared.

    The level at which water fills the vessels is found exactly from the sources ordered by size over weight. Window
    functions run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("most", CAP * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # if the sources before this one are full, the rest share what is left at this level
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source in this order that its level does not overfill sets the level of all
    s = s.withColumn("turn", F.row_number().over(up))
    s = s.withColumn("fill", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("turn", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "weight", F.when(F.col("fill").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("fill") * F.col("weight"))).alias("target"))


def _tilts(ws: Workspace, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, full, tilt): the dual variable per mean size of the source, or full where every rate is the cap."""
    x = F.col("size") / F.col("scale")
    means = sizes.groupBy(F.col("source").alias("of")).agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("scale"))
    state = targets.join(means, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), (F.col("target") >= CAP * F.col("source_size")).alias("full"), F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done")
    )
    state = ws.keep(state, "tilt0")
    for step in range(1, STEPS + 1):
        rate = F.least(F.lit(CAP), F.exp(F.least(F.col("tilt") * x, F.lit(1.0))))
        free = F.when(F.col("tilt") * x < F.log(F.lit(CAP)), rate).otherwise(0.0)
        own = sizes.select(F.col("source").alias("of"), "size", "docs").join(sized(state), F.col("of").eqNullSafe(F.col("source")))
        sums = own.groupBy(*state.columns).agg(F.sum(F.col("docs") * F.col("size") * rate).alias("value"), F.sum(F.col("docs") * F.col("size") * x * free).alias("slope"))
        gap = F.col("value") - F.col("target")
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        moved = sums.withColumn("lo2", lo).withColumn("hi2", hi).withColumn("newton", F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope")))
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        # without a Newton point: double away from an end not yet found, else halve
        far = F.when(F.col("lo2") <= -1e6, F.least(2 * F.col("tilt"), F.lit(-1.0))).when(F.col("hi2") >= 1e6, F.greatest(2 * F.col("tilt"), F.lit(1.0))).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        done = F.col("full") | (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        state = moved.select("source", "target", "scale", "full", F.when(done, F.col("tilt")).when(inside, F.col("newton")).otherwise(far).alias("tilt"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), done.alias("done"))
        state = ws.keep(state, f"tilt{step}")
        if state.where("not done").isEmpty():
            break
    return state.select(F.col("source").alias("tilt_source"), "scale", "full", "tilt")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> DataFrame:
    """How often each document is taken, so that every source comes near its target of words.

    Returns one row per input row: id, source, size (words), source_size, target (of its source), copies, taken (words,
    copies * size). A null or empty text has size 0 and takes nothing. Null is a source of its own, ordered last. Rows
    that repeat an id are rounded alike; a null id has a hash of its own. Ties need no rule: equal rows are treated
    equally. The result depends on the rows only, not on their order or partitions. Other columns are not read. An
    empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    sized_docs = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    base = ws.keep(sized_docs, "docs")
    sizes = ws.keep(base.groupBy("source", "size").agg(F.count("*").alias("docs")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = ws.keep(source_targets(sources, weights, share), "targets")
    tilts = _tilts(ws, sizes, targets)
    plan = ws.keep(targets.join(tilts, F.col("source").eqNullSafe(F.col("tilt_source"))).select(F.col("source").alias("of"), "source_size", "target", "scale", "full", "tilt"), "plan")
    rate = F.when(F.col("full"), F.lit(CAP)).otherwise(F.least(F.lit(CAP), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(1.0)))))
    rated = base.join(sized(plan), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("rate", rate)
    # ticket: the shift from which on a document takes one copy more; u lies in [0, 1)
    u = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    whole = F.least(F.floor("rate"), F.lit(int(CAP) - 1))
    ticket = F.when(F.col("full"), F.lit(-1.0)).otherwise(u - (F.col("rate") - whole))
    cell = F.least(F.greatest(F.floor((ticket + 1.0) * (CELLS / 2)), F.lit(0)), F.lit(CELLS - 1))
    cells = rated.select("id", "source", "size", "source_size", "target", whole.alias("whole"), ticket.alias("ticket"), cell.alias("cell"))
    per_cell = ws.keep(cells.groupBy("source", "target", "cell").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.sum("size").alias("more")), "cells")
    w = Window.partitionBy("source")
    run = w.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = per_cell.withColumn("sure", F.sum("sure").over(w)).withColumn("upto", F.sum("more").over(run))
    # the cell in which the words taken pass the target; all cells before it are taken
    last = met.withColumn("short", F.col("target") - F.col("sure") - (F.col("upto") - F.col("more"))).where((F.col("short") > 0) & (F.col("short") <= F.col("more")))
    turn = ws.keep(last.groupBy(F.col("source").alias("turn_source")).agg(F.min("cell").alias("turn"), F.max_by("short", -F.col("cell")).alias("short")), "turn")
    reach = ws.keep(met.groupBy(F.col("source").alias("reach_source")).agg((F.max("target") > F.max("sure")).alias("wants")), "reach")
    ends = ws.keep(reach.join(turn, F.col("reach_source").eqNullSafe(F.col("turn_source")), "left").select(F.col("reach_source").alias("end_source"), "wants", "turn", "short"), "ends")
    placed = cells.join(sized(ends), F.col("source").eqNullSafe(F.col("end_source")), "left")
    inner = placed.where("cell = turn").groupBy("source", "ticket").agg(F.sum("size").alias("more"), F.max("short").alias("short"))
    before = F.sum("more").over(Window.partitionBy("source").orderBy("ticket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # nearest to the target: a ticket is taken if at least half of it fits
    taken_up_to = inner.withColumn("upto", before).where(F.col("upto") - F.col("more") / 2.0 <= F.col("short")).groupBy(F.col("source").alias("cut_source")).agg(F.max("ticket").alias("cut"))
    cut = ws.keep(taken_up_to, "cut")
    more = F.when(F.col("turn").isNull(), F.col("wants")).when(F.col("cell") != F.col("turn"), F.col("cell") < F.col("turn")).otherwise(F.coalesce(F.col("ticket") <= F.col("cut"), F.lit(False)))
    copies = (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long")
    return placed.join(sized(cut), F.col("source").eqNullSafe(F.col("cut_source")), "left").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
