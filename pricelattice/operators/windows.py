"""Window operators: change capture, slowly changing dimensions, moving and clamped series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row counts. Adds prev_value and delta."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("prev_value", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return out.filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("prev_value"))).drop("_n").withColumn("delta", F.col(value) - F.col("prev_value"))


def scd2(df: DataFrame, by: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """valid_from, valid_to (open end null) and is_current for runs of equal values."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p")))
    out = starts.withColumn("valid_to", F.lead(at).over(w)).withColumn("is_current", F.col("valid_to").isNull())
    return out.select(*by, value, F.col(at).alias("valid_from"), "valid_to", "is_current")


def moving(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("moving_avg", F.avg(value).over(w)).withColumn("moving_sum", F.sum(value).over(w))


def change_over(df: DataFrame, by: list[str], order: list[str], value: str, lag: int) -> DataFrame:
    """Relative and absolute change against the row `lag` before (12 months: year over year)."""
    prev = F.lag(value, lag).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("pct_change", F.when(prev != 0, F.col(value) / prev - 1)).withColumn("diff", F.col(value) - prev)


def jump_while_flat(df: DataFrame, by: list[str], order: list[str], retail: str, wholesale: str, jump: float = 0.5, flat: float = 0.05) -> DataFrame:
    """Rows with a retail rise of `jump` or more while wholesale moved at most `flat`."""
    w = Window.partitionBy(*by).orderBy(*order)
    r, s = F.lag(retail).over(w), F.lag(wholesale).over(w)
    out = df.withColumn("retail_change", F.when(r > 0, F.col(retail) / r - 1)).withColumn("wholesale_change", F.when(s > 0, F.col(wholesale) / s - 1))
    return out.filter((F.col("retail_change") >= jump) & (F.abs("wholesale_change") <= flat))


def running_product(df: DataFrame, by: list[str], order: list[str], rate: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("factor", F.exp(F.sum(F.log1p(F.col(rate))).over(w)))


def _then(a: Column, b: Column) -> Column:
    """The clamp b after the clamp a. A clamp (s, lo, hi) takes x to min(hi, max(lo, x + s)); two in a row are one again."""
    put = lambda x: F.least(F.greatest(x + b["s"], b["lo"]), b["hi"])
    return F.struct((a["s"] + b["s"]).alias("s"), put(a["lo"]).alias("lo"), put(a["hi"]).alias("hi"))


def _put(x: Column, c: Column) -> Column:
    return F.least(F.greatest(x + c["s"], c["lo"]), c["hi"])


def _carried(blocks: DataFrame, by: list[str], at: str, start: float, lot: int) -> DataFrame:
    """by, at, _x: the state before each block. Blocks are taken in lots, lots in lots of lots, till one lot holds a key's."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(at)) - 1
    lots = blocks.withColumn("_lot", F.floor(place / lot).cast("bigint")).groupBy(*by, "_lot").agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("_c").alias("c")))).alias("_in"))
    whole = F.aggregate(F.slice("_in", 2, F.size("_in")), F.element_at("_in", 1)["c"], lambda a, x: _then(a, x["c"]))
    above = lots.select(*by, "_lot", whole.alias("_c"))
    far = above.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_lot", F.col("_c").alias("c")))).alias("_all"))
    steps = F.aggregate("_all", F.struct(F.lit(start).alias("x"), F.array(F.struct(F.lit(-1).cast("bigint").alias("lot"), F.lit(start).alias("x"))).alias("out")), lambda a, l: F.struct(_put(a["x"], l["c"]).alias("x"), F.concat(a["out"], F.array(F.struct(l["_lot"].alias("lot"), _put(a["x"], l["c"]).alias("x")))).alias("out")))
    before = far.select(*by, F.explode(steps["out"]).alias("_s")).select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], (F.col("_s.lot") + 1).alias("_l"), F.col("_s.x").alias("_x0"))
    on = F.col("_lot") == F.col("_l")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    inner = F.aggregate("_in", F.struct(F.col("_x0").alias("x"), F.filter(F.array(F.struct(F.element_at("_in", 1)["at"].alias("at"), F.col("_x0").alias("x"))), lambda _: F.lit(False)).alias("out")), lambda a, l: F.struct(_put(a["x"], l["c"]).alias("x"), F.concat(a["out"], F.array(F.struct(l["at"].alias("at"), a["x"].alias("x")))).alias("out")))
    return lots.join(before, on).select(*by, F.explode(inner["out"]).alias("_s")).select(*by, F.col("_s.at").alias(at), F.col("_s.x").alias("_x"))


def clamped_balance(df: DataFrame, by: list[str], at: str, delta: Column, start: float = 75.0, lo: float = 0.0, hi: float = 150.0, bucket_s: int = 30 * 86400, lot: int = 256) -> DataFrame:
    """state[t] = clamp(state[t-1] + delta[t], lo, hi) in one chain per key: by, at, state.

    A key's rows are cut by time into buckets of bucket_s (seconds, or units of a numeric `at`) and further into blocks of `lot` rows. A
    run of clamped steps is one clamp (s, lo, hi), so blocks are put together side by side, the state before each is found from theirs,
    and only then rows are stepped through within their block: one key is spread over tasks and nothing leaves the JVM. A bucket is
    ordered in one task; its rows must be few enough for that. Equal times go by delta; a null delta leaves the state as it is; null
    times go first.
    """
    seconds = (F.col(at).cast("timestamp") if df.schema[at].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(at)).cast("double")
    rows = df.select(*by, F.col(at).alias("_at"), F.coalesce(delta.cast("double"), F.lit(0.0)).alias("_d"), F.coalesce(F.floor(seconds / bucket_s).cast("bigint"), F.lit(-(1 << 62))).alias("_b"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_at", "_d")) - 1
    blocks = rows.withColumn("_n", F.floor(place / lot).cast("int")).groupBy(*by, "_b", "_n").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").isNotNull().alias("k"), F.col("_at").alias("at"), F.col("_d").alias("d")))).alias("_rows"))
    step = lambda d: F.struct(d.alias("s"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    whole = F.aggregate(F.slice("_rows", 2, F.size("_rows")), step(F.element_at("_rows", 1)["d"]), lambda a, r: _then(a, step(r["d"])))
    blocks = blocks.withColumn("_at_block", F.struct("_b", "_n"))
    before = _carried(blocks.select(*by, "_at_block", whole.alias("_c")), by, "_at_block", float(start), lot)
    before = before.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_at_block").alias("_ab"), "_x")
    on = F.col("_at_block") == F.col("_ab")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    states = F.aggregate("_rows", F.struct(F.col("_x").alias("x"), F.array().cast("array<double>").alias("out")), lambda a, r: F.struct(_put(a["x"], step(r["d"])).alias("x"), F.concat(a["out"], F.array(_put(a["x"], step(r["d"])))).alias("out")))["out"]
    out = blocks.join(before, on).select(*by, F.explode(F.arrays_zip(F.col("_rows"), states.alias("x"))).alias("_z"))
    return out.select(*by, F.col("_z._rows.at").alias(at), F.col("_z.x").alias("state"))


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key; the rank filter is pushed below the shuffle by the window group limit."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
