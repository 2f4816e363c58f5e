"""Joins that the built-in join() does not say in one call. All are equi-joins underneath, so none needs a nested loop."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.operators.cells import nearest_within


def _seconds(df: DataFrame, c: str) -> Column:
    """A number, or the seconds of a timestamp with or without a zone."""
    return (F.col(c).cast("timestamp") if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c)).cast("double")


def full_outer_null_safe(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer join in which null keys match each other; clashing value columns get suffixes."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    l = left.select(*[F.col(c).alias(f"l_{c}") if c in keys else F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns])
    r = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c).alias(c + suffixes[1] if c in clash else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys])
    out = l.join(r, on, "full")
    rest = [c for c in [*l.columns, *r.columns] if c not in {f"{s}_{k}" for k in keys for s in "lr"}]
    return out.select(*[F.coalesce(F.col(f"l_{k}"), F.col(f"r_{k}")).alias(k) for k in keys], *rest)


def merge_on_time(left: DataFrame, right: DataFrame, candidates: tuple[str, ...] = ("date", "time", "hour")) -> DataFrame:
    """Full outer join on the time columns that both sides have."""
    keys = [k for k in candidates if k in left.columns and k in right.columns]
    if not keys:
        raise ValueError(f"no shared time column among {candidates}")
    return full_outer_null_safe(left, right, keys)


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tolerance_s: float | None = None) -> DataFrame:
    """Left rows with the newest right row at or before them, for each `by` key.

    Union, one shuffle on `by`, and a running last(): no range join. `values` are right columns. A by-key is read in order by one
    task; where one key may hold a large share of all rows, add a time bucket with bucketed_asof().
    """
    cols = left.columns
    l = left.select(F.lit(1).alias("_side"), F.struct(*cols).alias("_l"), *[F.col(b) for b in by], F.col(on), F.lit(None).cast(_struct_type(right, [*values, on])).alias("_r"))
    r = right.select(F.lit(0).alias("_side"), F.lit(None).cast(_struct_type(left, cols)).alias("_l"), *[F.col(b) for b in by], F.col(on), F.struct(*values, on).alias("_r"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    ok = F.lit(True) if tolerance_s is None else (F.col(f"_l.{on}").cast("timestamp").cast("double") - F.col(f"_hit.{on}").cast("timestamp").cast("double") <= tolerance_s)
    return out.select("_l.*", *[F.when(ok, F.col(f"_hit.{v}")).alias(f"asof_{v}") for v in [*values, on]])


def _struct_type(df: DataFrame, cols: list[str]):
    return df.select(F.struct(*cols).alias("s")).schema["s"].dataType


def bucketed_asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], bucket_s: int = 86400) -> DataFrame:
    """asof() for hot keys: the key is split by time bucket, and each bucket starts with the last right row before it.

    That carry is a window over one row per (key, bucket), so no task reads all rows of a key.
    """
    cols = left.columns
    bucket = lambda c: F.floor(_seconds(left, c) / bucket_s).cast("bigint")
    r = right.select(*by, F.col(on), F.struct(on, *values).alias("_r"), bucket(on).alias("_b"))
    newest = r.groupBy(*by, "_b").agg(F.max_by("_r", on).alias("_r"))
    lb = left.select(*by, bucket(on).alias("_b")).distinct()
    spine = lb.withColumn("_need", F.lit(True)).join(newest, [*by, "_b"], "full")
    before = F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carry = spine.withColumn("_c", before).filter("_need").select(*by, "_b", F.col("_c").alias("_r")).filter("_r is not null")
    first = carry.select(*by, "_b", F.lit(None).cast(left.schema[on].dataType).alias(on), F.lit(0).alias("_side"), F.lit(None).cast(_struct_type(left, cols)).alias("_l"), "_r")
    rr = r.select(*by, "_b", on, F.lit(1).alias("_side"), F.lit(None).cast(_struct_type(left, cols)).alias("_l"), "_r")
    ll = left.select(*by, bucket(on).alias("_b"), F.col(on), F.lit(2).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
    w = Window.partitionBy(*by, "_b").orderBy(F.col(on).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = first.unionByName(rr).unionByName(ll).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).filter("_side = 2")
    return out.select("_l.*", *[F.col(f"_hit.{v}").alias(f"asof_{v}") for v in [*values, on]])


def event_study(events: DataFrame, series: DataFrame, day: str, value: str, offsets: list[int], by: list[str] | None = None) -> DataFrame:
    """Series value on day + offset for each event and offset: exploded equi-keys in place of a range join."""
    keys = by or []
    e = events.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_d", F.date_add(F.col(day), F.col("offset")))
    s = series.select(*keys, F.col(day).alias("_d"), F.col(value).alias("effect_value"))
    return e.join(s, [*keys, "_d"], "left").withColumnRenamed("_d", "effect_day")


#: Each level of spans has buckets so many times as wide as the one before.
LEVEL_STEP = 8


def interval_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: float, by: list[str] | None = None, longest: float | None = None) -> DataFrame:
    """Points within [lo, hi] of a span: an equi-join on buckets of `width`.

    A span goes to each bucket that it touches, so spans should be about as long as a bucket is wide. Where `longest` is stated (in the
    unit of width), spans are sorted into levels of wider and wider buckets by their length, touch at most LEVEL_STEP + 1 of their level,
    and a point asks every level up to that of the longest; longer spans than stated stay at the last level and are found all the same.
    """
    keys = by or []
    levels = 1 if longest is None else max(1, math.ceil(math.log(max(longest / width, 1.0), LEVEL_STEP)) + 1)
    p = points.withColumn("_v", F.explode(F.array(*map(F.lit, range(levels))))) if levels > 1 else points.withColumn("_v", F.lit(0))
    bucket = lambda t, level: F.floor(t / (width * F.pow(F.lit(float(LEVEL_STEP)), level))).cast("bigint")
    p = p.withColumn("_k", bucket(_seconds(points, at), F.col("_v")))
    a, b = _seconds(spans, lo), _seconds(spans, hi)
    level = F.least(F.lit(levels - 1), F.ceil(F.log(F.greatest((b - a) / width, F.lit(1.0))) / math.log(LEVEL_STEP) - 1e-9)).cast("int")
    s = spans.filter(F.col(lo) <= F.col(hi)).withColumn("_v", level).withColumn("_k", F.explode(F.sequence(bucket(a, F.col("_v")), bucket(b, F.col("_v")))))
    return p.join(s, [*keys, "_v", "_k"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_k", "_v")


def nearest_site(points: DataFrame, sites: DataFrame, radius_km: float, point_id: str, site_id: str) -> DataFrame:
    """Nearest site of each point within a radius, at every latitude and across the date line; of equally near sites the least id."""
    hits = nearest_within(points, sites, radius_km, site_id)
    all_ = points.select(point_id, "lat", "lon").join(hits, ["lat", "lon"])
    return all_.groupBy(point_id).agg(F.min(F.struct("distance_km", site_id)).alias("_m")).select(point_id, F.col(f"_m.{site_id}").alias(site_id), F.col("_m.distance_km").alias("distance_km"))


def nearest_with_fallback(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, radii: tuple[float, ...] = (10.0, 25.0, 50.0)) -> DataFrame:
    """nearest_site() with growing radii: the nearest site of the first radius that reaches one is the nearest of all."""
    first = reduce(lambda rest, r: F.when(F.col("distance_km") <= r, F.lit(r)).otherwise(rest), reversed(radii), F.lit(None).cast("double"))
    return nearest_site(points, sites, max(radii), point_id, site_id).withColumn("radius_km", first)


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], bound_rows: int = 100_000) -> DataFrame:
    """Left join to a dimension: broadcast when a bounded count shows that it has at most `bound_rows`, else a shuffle join."""
    small = dim.limit(bound_rows + 1).count() <= bound_rows
    return df.join(F.broadcast(dim) if small else dim, keys, "left")


STRATEGIES = ("broadcast", "merge", "shuffle_hash")


def by_strategy(left: DataFrame, right: DataFrame, keys: list[str], strategy: str | None = None, how: str = "inner") -> DataFrame:
    """Equi-join by a strategy that the caller knows to be right (broadcast: the right side is small on every run), or by Spark's choice."""
    if strategy is not None and strategy not in STRATEGIES:
        raise ValueError(strategy)
    return left.join(right.hint(strategy) if strategy else right, keys, how)


def first_rule_join(key: Column, rules: list[tuple[int, str, str]], both_ways: bool = True) -> Column:
    """Target of the first rule (ordinal, needle, target) that matches by containment, as a column over a literal array."""
    arr = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(n).alias("n"), F.lit(t).alias("t")) for o, n, t in sorted(rules)])
    hit = F.filter(arr, lambda r: key.contains(r["n"]) | (r["n"].contains(key) if both_ways else F.lit(False)))
    return F.when(F.length(key) > 0, F.try_element_at(hit, F.lit(1))["t"])


def block_similarity(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, threshold: float, within: tuple[str, ...] = (), sep: str = r"\s+", digits: int | None = None) -> DataFrame:
    """Every pair of names whose token sets have a Jaccard similarity of at least `threshold` (above 0), among rows equal in `within`.

    Equal token sets are compared once. A set is blocked by its rarest tokens only: of n tokens, n - ceil(threshold * n) + 1, since two
    sets that share none of those cannot reach the threshold. Null names have no pairs. Equal sets' ids meet as lists, not row by row;
    where `digits` is given, the similarity is rounded once for all of them.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    keys = [f"_k{i}" for i in range(len(within))]
    words = F.array_sort(F.array_distinct(F.split(F.trim(F.lower(F.col(text))) if sep == r"\s+" else F.lower(F.col(text)), sep)))
    rows = lambda df, i, w: df.select(F.col(i), *[F.col(c).alias(k) for c, k in zip(within, keys, strict=True)], words.alias(w)).filter(F.col(w).isNotNull())
    l, r = rows(left, left_id, "_wa"), rows(right, right_id, "_wb")
    sets = l.select(*keys, F.col("_wa").alias("_w")).unionByName(r.select(*keys, F.col("_wb").alias("_w"))).distinct()
    tokens = sets.withColumn("_t", F.explode("_w"))
    ranked = tokens.join(tokens.groupBy("_t").agg(F.count("*").alias("_n")), "_t").groupBy(*keys, "_w").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_by"))
    many = F.size("_w") - F.ceil(F.size("_w") * threshold - 1e-9).cast("int") + 1
    blocks = ranked.select(*keys, "_w", F.explode(F.slice("_by", F.lit(1), many)).alias("_b")).select(*keys, "_w", F.col("_b._t").alias("_t"))
    pairs = blocks.withColumnRenamed("_w", "_wa").join(blocks.withColumnRenamed("_w", "_wb"), [*keys, "_t"]).select(*keys, "_wa", "_wb").distinct()
    sim = F.size(F.array_intersect("_wa", "_wb")) / F.size(F.array_union("_wa", "_wb"))
    pairs = pairs.withColumn("similarity", sim).filter(F.col("similarity") >= threshold)
    if digits is not None:
        pairs = pairs.withColumn("similarity", F.round("similarity", digits))
    lists = _id_lists(l, [*keys, "_wa"], left_id).join(pairs, [*keys, "_wa"]).join(_id_lists(r, [*keys, "_wb"], right_id), [*keys, "_wb"])
    lists = lists.select(f"_of_{left_id}", f"_of_{right_id}", "similarity").repartition(4 * left.sparkSession.sparkContext.defaultParallelism)
    out = lists.select(F.explode(f"_of_{left_id}").alias("_l"), f"_of_{right_id}", "similarity").select("_l", F.explode(f"_of_{right_id}").alias("_r"), "similarity")
    return out.select(F.col("_l.id").alias(left_id), F.col("_r.id").alias(right_id), "similarity")


#: Ids of one token set that stand in one list.
ID_LIST = 2048


def _id_lists(rows: DataFrame, by: list[str], row_id: str) -> DataFrame:
    """The rows' ids by `by`, in lists of some ID_LIST: lists meet in the join, and ids are paired only where the result is written."""
    parts = rows.groupBy(*by).agg(F.ceil(F.count("*") / ID_LIST).alias("_many"))
    part = F.pmod(F.xxhash64(row_id), F.col("_many")).alias("_part")
    one = F.struct(F.col(row_id).alias("id"))
    return rows.join(parts, by).select(*by, part, one.alias("_id")).groupBy(*by, "_part").agg(F.collect_list("_id").alias(f"_of_{row_id}")).drop("_part")
