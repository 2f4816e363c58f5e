"""Mixing sources to target weights by entropy balancing.

A document of size x is taken at a rate r; of all rates between 0 and `most` that give each source its target tokens, the mix has those
of least relative entropy sum(r log r - r + 1) to one copy of every document. Their dual is convex, one unknown t a source, and tilts
rates exponentially: r = min(most, exp(t x)). Newton's method solves it for all sources at once, a Spark aggregation an iteration, over
the number of documents of each (source, size) instead of the documents; it steps on the logarithm of the constraint, which is convex in
t while no rate is capped, and halves the bracket where a step would leave it. A source whose target is all it may give has the rate
`most` throughout.

Rates become copies in whole numbers. Along the sizes of a source, cell by cell, the copies are what the running sum of n x rate passes in
whole numbers, so the tokens are never off by more than the largest document; then up to FIXES cells, each that which lies nearest to
what is still missing, give or take one copy. Inside a cell the documents share its copies evenly, the odd ones go by a hash of (doc_id,
text). Sums that decide anything are of integers or decimals, so reruns agree whatever the order of rows. Equal rows are one row with a
number until the end, and the rank of a document in its cell is found by ranges of the hash; so neither a cell nor a repeated row with a
third of all rows is one task's.

Targets: sources in the order of their names, null last, have the weights 5, 2, 1, 5, 2, 1 and so on, and share all tokens by them; a
source stops at `most` times its own tokens and the rest is shared by the others, until none is above.

Null text has size 0; such documents are taken 0 words (their copies follow the rate). A null source is a source. Repeated rows and null
or repeated doc_id are mixed row by row. Columns other than those kept (which cannot be maps) are ignored. A table without words has targets 0; an empty one gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.llm.store import written

MOST, WEIGHTS = 3, (5, 2, 1)
#: Relative error of a source's tokens at which Newton's method ends, and iterations after which it ends anyway (bisection has then halved the bracket often enough).
TOLERANCE, ITERATIONS, FIXES = 1e-9, 80, 3
#: A rate in whole numbers, and documents of a cell that one task ranks.
UNIT, RANKED = 1 << 24, 1 << 12


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def sized(docs: DataFrame, keep: list[str], size: Column) -> DataFrame:
    """The columns of `keep` as __pl_keep, __pl_source, __pl_size, __pl_hash; equal rows once, with their number as __pl_m. Written."""
    own = F.struct(*[F.col(k) for k in keep]).alias("__pl_keep")
    narrow = docs.select(own, F.col("source").cast("string").alias("__pl_source"), size.alias("__pl_size"), F.xxhash64("doc_id", "text").alias("__pl_hash"))
    return written(narrow.groupBy("__pl_hash", "__pl_source", "__pl_size", "__pl_keep").agg(F.count(F.lit(1)).alias("__pl_m")), "sizes")


def ordered(sources: DataFrame) -> DataFrame:
    """Adds __pl_place, the rank of a source by name, null last. Ranges of names are ranked side by side."""
    by = F.col("source").asc_nulls_last()
    ranged = written(sources.repartitionByRange(by).withColumn("__pl_range", F.spark_partition_id()), "ranges")
    own = ranged.withColumn("__pl_in", F.row_number().over(Window.partitionBy("__pl_range").orderBy(by)))
    sizes = ranged.groupBy("__pl_range").agg(F.count(F.lit(1)).alias("__pl_n"))
    before = sizes.withColumn("__pl_before", F.sum("__pl_n").over(Window.orderBy("__pl_range").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["__pl_before"])
    return own.join(before, "__pl_range").withColumn("__pl_place", F.col("__pl_before") + F.col("__pl_in") - 1).drop("__pl_range", "__pl_in", "__pl_n", "__pl_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, from source and source_size. Each round finds the sources above the common level of the others."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__pl_place") % len(weights) + 1).cast("int"))
    table = written(ordered(sources).withColumn("__pl_weight", weight.cast("bigint")).drop("__pl_place"), "sources")
    total, rest, free, full = table.agg(F.sum("source_size")).first()[0] or 0, None, None, F.lit(False)
    own = F.col("source_size").cast("decimal(38,0)")
    while True:
        r = table.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0)).alias("at_most"), F.sum(F.when(full, 0).otherwise(F.col("__pl_weight"))).alias("free")).first()
        level = (total - (r.at_most or 0), r.free or 0)
        if level == (rest, free) or not level[1]:
            break
        rest, free = level
        full = most * own * F.lit(free).cast("decimal(38,0)") < F.lit(rest).cast("decimal(38,0)") * F.col("__pl_weight")
    shared = F.lit(float(rest or 0)) * F.col("__pl_weight") / F.lit(float(free or 1))
    return table.select("source", "source_size", F.when(full, F.col("source_size").cast("double") * most).otherwise(shared).alias("target"))


def exact(x: Column) -> Column:
    """A double as a decimal, whose sums do not depend on order."""
    return x.cast("decimal(38,9)")


def tilts(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, tilt: Newton's iterations. cells: source, size, n (documents). A null tilt stands for the rate `most`."""
    open_ = F.col("target") < most * F.col("source_size").cast("double")
    state = goals.withColumn("tilt", F.when(open_, 0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    x = F.col("size").cast("double")
    state = written(state, "tilts")
    for k in range(ITERATIONS):
        s = state.select(F.col("source").alias("__pl_s"), "tilt").filter("tilt is not null")
        at = cells.filter("size > 0").join(s, F.col("source").eqNullSafe(F.col("__pl_s")))
        rate = F.least(F.exp(F.col("tilt") * x), F.lit(float(most)))
        mass = F.col("n") * x * rate
        sums = at.groupBy("__pl_s").agg(F.sum(exact(mass)).cast("double").alias("given"), F.sum(exact(F.when(rate < most, mass * x).otherwise(0.0))).cast("double").alias("slope"))
        now = state.join(sums, F.col("source").eqNullSafe(F.col("__pl_s")), "left").drop("__pl_s").withColumn("off", F.col("given") / F.col("target") - 1)
        tilt, low, high = F.col("tilt"), F.coalesce(F.when(F.col("off") < 0, F.col("tilt")), F.col("low")), F.coalesce(F.when(F.col("off") > 0, F.col("tilt")), F.col("high"))
        step = tilt - F.when(F.col("slope") > 0, F.log(F.col("given") / F.col("target")) * F.col("given") / F.col("slope"))
        inside = step.isNotNull() & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        half = F.coalesce((F.col("low") + F.col("high")) / 2, F.col("low") * 2 + 1, F.col("high") * 2 - 1)
        done = F.col("tilt").isNull() | (F.abs("off") <= TOLERANCE)
        now = now.withColumns({"low": low, "high": high}).select("source", "source_size", "target", F.when(done, tilt).when(inside, step).otherwise(half).alias("tilt"), "low", "high", (~done).alias("open"))
        state = written(now, f"tilts_{k}")
        if not state.filter("open").limit(1).count():
            break
    return state.select("source", "source_size", "target", "tilt")


def cell_copies(cells: DataFrame, tilted: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, size, n, tilt and the whole number of copies that the n documents of the cell give together."""
    t = tilted.withColumnRenamed("source", "__pl_s")
    rate = F.coalesce(F.least(F.exp(F.col("tilt") * F.col("size")), F.lit(float(most))), F.lit(float(most)))
    c = cells.join(t, F.col("source").eqNullSafe(F.col("__pl_s"))).drop("__pl_s").withColumn("__pl_q", F.col("n") * F.round(rate * UNIT).cast("bigint"))
    # Running sums by blocks of sizes: a source's sizes need not lie in one task.
    block = F.shiftright(F.col("size"), 10)
    c = c.withColumn("__pl_block", block)
    sums = c.groupBy("source", "__pl_block").agg(F.sum("__pl_q").alias("__pl_b"))
    earlier = Window.partitionBy("source").orderBy("__pl_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__pl_before", F.coalesce(F.sum("__pl_b").over(earlier), F.lit(0))).select(F.col("source").alias("__pl_s"), F.col("__pl_block").alias("__pl_k"), "__pl_before")
    c = c.join(sums, F.col("source").eqNullSafe(F.col("__pl_s")) & (F.col("__pl_block") == F.col("__pl_k")))
    upto = F.col("__pl_before") + F.sum("__pl_q").over(Window.partitionBy("source", "__pl_block").orderBy("size"))
    whole = lambda s: F.call_function("div", s + UNIT // 2, F.lit(UNIT))
    c = c.withColumn("__pl_upto", upto).withColumn("copies", whole(F.col("__pl_upto")) - whole(F.col("__pl_upto") - F.col("__pl_q")))
    c = c.withColumn("copies", F.greatest(F.lit(0), F.least("copies", most * F.col("n"))))
    c = written(c.select("source", "source_size", "target", "size", "n", "tilt", "copies"), "cells_copied")
    for k in range(FIXES):
        off = c.groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) - F.round(F.first("target")).cast("bigint")).alias("__pl_off"))
        off = off.withColumnRenamed("source", "__pl_s")
        j = c.join(off, F.col("source").eqNullSafe(F.col("__pl_s"))).drop("__pl_s")
        room = F.when(F.col("__pl_off") > 0, F.col("copies") > 0).otherwise(F.col("copies") < most * F.col("n")) & (F.col("size") > 0)
        left = F.abs(F.abs("__pl_off") - F.col("size"))
        best = j.filter(room & (left < F.abs("__pl_off"))).groupBy("source").agg(F.min_by("size", F.struct(left, "size")).alias("__pl_size"), F.first("__pl_off").alias("__pl_off"))
        best = best.withColumnRenamed("source", "__pl_s")
        j = c.join(best, F.col("source").eqNullSafe(F.col("__pl_s")) & (F.col("size") == F.col("__pl_size")), "left")
        c = written(j.withColumn("copies", F.col("copies") - F.coalesce(F.signum("__pl_off").cast("bigint"), F.lit(0))).select(*c.columns), f"cells_fixed_{k}")
    return c


def shared_out(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """__pl_keep, __pl_source, __pl_size, __pl_total, __pl_target and __pl_copies of every document: its cell's copies evenly, the odd ones
    to the least hashes."""
    cell = ["__pl_source", "__pl_size"]
    names = {"source": "__pl_s", "size": "__pl_z", "n": "__pl_n", "copies": "__pl_all", "source_size": "__pl_total", "target": "__pl_target"}
    c = cells.select(*[F.col(k).alias(v) for k, v in names.items()])
    j = rows.join(c, F.col("__pl_source").eqNullSafe(F.col("__pl_s")) & (F.col("__pl_size") == F.col("__pl_z"))).drop("__pl_s", "__pl_z")
    # The upper 31 bits of the hash, cut into as many ranges as the cell has lots of RANKED documents.
    ranges = F.ceil(F.col("__pl_n") / RANKED)
    j = j.withColumn("__pl_range", F.shiftright(F.shiftrightunsigned("__pl_hash", 33) * ranges, 31))
    sums = j.groupBy(*cell, "__pl_range").agg(F.sum("__pl_m").alias("__pl_sum"))
    in_cell = Window.partitionBy(*cell).orderBy("__pl_range").rowsBetween(Window.unboundedPreceding, -1)
    front = sums.select(F.col("__pl_source").alias("__pl_s"), F.col("__pl_size").alias("__pl_z"), F.col("__pl_range").alias("__pl_r"), F.coalesce(F.sum("__pl_sum").over(in_cell), F.lit(0)).alias("__pl_front"))
    j = j.join(front, F.col("__pl_source").eqNullSafe(F.col("__pl_s")) & (F.col("__pl_size") == F.col("__pl_z")) & (F.col("__pl_range") == F.col("__pl_r")))
    own = Window.partitionBy(*cell, "__pl_range").orderBy("__pl_hash", "__pl_keep").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__pl_front") + F.coalesce(F.sum("__pl_m").over(own), F.lit(0))
    odd = F.greatest(F.lit(0), F.least(F.col("__pl_all") % F.col("__pl_n") - rank, F.col("__pl_m")))
    j = j.select("__pl_keep", *cell, "__pl_total", "__pl_target", "__pl_m", F.call_function("div", F.col("__pl_all"), F.col("__pl_n")).alias("__pl_each"), odd.alias("__pl_odd"))
    # Equal rows part again, in lots that are dealt to tasks.
    lots = j.withColumn("__pl_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("__pl_m") - 1, F.lit(RANKED)))))
    hot = F.when(F.col("__pl_m") > RANKED, F.col("__pl_lot")).otherwise(F.xxhash64("__pl_keep"))
    lots = lots.repartition(hot, "__pl_lot")
    first = F.col("__pl_lot") * RANKED
    each = lots.withColumn("__pl_i", F.explode(F.sequence(first, F.least(first + RANKED, "__pl_m") - 1)))
    return each.withColumn("__pl_copies", F.col("__pl_each") + (F.col("__pl_i") < F.col("__pl_odd")).cast("bigint"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, names: tuple[str, ...] = ("size", "source_size", "target", "taken", "copies")) -> DataFrame:
    """`keep` columns (doc_id) and, under `names`: words of the text, words of the source, target of the source, words taken, copies."""
    rows = sized(docs, keep or ["doc_id"], words(F.col("text")))
    cells = written(rows.groupBy(F.col("__pl_source").alias("source"), F.col("__pl_size").alias("size")).agg(F.sum("__pl_m").alias("n")), "cells")
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    out = shared_out(rows, cell_copies(cells, tilts(cells, goals, most), most))
    values = [F.col("__pl_size"), F.col("__pl_total"), F.col("__pl_target"), F.col("__pl_copies") * F.col("__pl_size"), F.col("__pl_copies")]
    return out.select("__pl_keep.*", *[v.alias(n) for v, n in zip(values, names, strict=True)])


def repeated(mixed: DataFrame, copies: str = "copies", number: str = "copy") -> DataFrame:
    """The mix itself: every row as often as it has copies, numbered from 1."""
    return mixed.filter(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
