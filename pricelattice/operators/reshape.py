"""Nested, wide and generated shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.text import join_items


def flatten_depots(df: DataFrame, listing: str = "productDepotInfoList") -> DataFrame:
    """One row for each depot of a product, one row of nulls when it has none; depot fields win over product fields of that name."""
    depot = [f.name for f in df.schema[listing].dataType.elementType.fields]
    keep = [c for c in df.columns if c not in {listing, *depot, "categories"}]
    cats = [join_items(F.col("categories")).alias("categories")] if "categories" in df.columns else []
    return df.withColumn("_d", F.explode_outer(listing)).select(*keep, *cats, *[F.col(f"_d.{c}").alias(c) for c in depot])


def wide_to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "series", value: str = "value") -> DataFrame:
    """Long rows without blanks; text that is no number is dropped too."""
    return df.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in values]).unpivot(ids, values, name, value).filter(F.col(value).isNotNull())


def pivot_sum(df: DataFrame, rows: list[str], column: str, names: list, value: Column, digits: int | None = None) -> DataFrame:
    """groupBy().pivot() with stated names, so no extra job lists them."""
    agg = F.sum(value) if digits is None else F.round(F.sum(value), digits)
    return df.groupBy(*rows).pivot(column, names).agg(agg)


def map_of_lists(df: DataFrame, col: str, key: str = "city") -> DataFrame:
    m = df.select(F.explode(col).alias(key, "_rows"))
    return m.select(key, F.explode("_rows").alias("_r")).select(key, "_r.*")


def grid_points(df: DataFrame, step_deg: Column) -> DataFrame:
    """Grid over [south, north] x [west, east], both ends in, six digits; integer sequences, so no error adds up."""
    n = lambda lo, hi: F.floor((F.col(hi) - F.col(lo) + 1e-9) / F.col("_step")).cast("int")
    g = df.withColumn("_step", step_deg)
    g = g.withColumn("_i", F.explode(F.sequence(F.lit(0), n("south", "north")))).withColumn("_j", F.explode(F.sequence(F.lit(0), n("west", "east"))))
    return g.withColumn("lat", F.round(F.col("south") + F.col("_i") * F.col("_step"), 6)).withColumn("lon", F.round(F.col("west") + F.col("_j") * F.col("_step"), 6)).drop("_i", "_j", "_step")


def date_spine(df: DataFrame, lo: str, hi: str, name: str = "day", step: str = "1 DAY") -> DataFrame:
    return df.withColumn(name, F.explode(F.expr(f"sequence({lo}, {hi}, INTERVAL {step})")))


def month_windows(df: DataFrame, lo: str, hi: str, months: int) -> DataFrame:
    """[lo, hi] cut into windows of `months` months that do not overlap."""
    out = df.withColumn("window_start", F.explode(F.expr(f"sequence({lo}, {hi}, INTERVAL {months} MONTH)")))
    return out.withColumn("window_end", F.least(F.date_sub(F.add_months("window_start", months), 1), F.col(hi)))


def densify(facts: DataFrame, dims: list[DataFrame], keys: list[str], fill: dict, bound_rows: int = 100_000) -> DataFrame:
    """Every combination of dimensions with the facts or a fill value; the product runs over the dimensions, never over facts. A dimension
    is broadcast when a bounded count shows that it has at most `bound_rows`."""
    spine = dims[0]
    for d in dims[1:]:
        small = d.limit(bound_rows + 1).count() <= bound_rows
        spine = spine.crossJoin(F.broadcast(d) if small else d)
    return spine.join(facts, keys, "left").fillna(fill)
