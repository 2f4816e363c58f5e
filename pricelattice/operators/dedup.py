"""Keyed deduplication and merges. Each is one shuffle on the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ascending `order`.

    min_by over a struct lets each map task combine before the shuffle, so a hot key costs one row per task; a window would
    gather all its rows in one task. `order` must be total for a stable answer.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in `order` (max_by, map-side combined)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def settled(df: DataFrame, keys: list[str]) -> list[Column]:
    """The columns beside `keys` that have an order (maps and variants have none), so that ties end alike on every run."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in keys}
    return [F.col(c) for c, k in kinds.items() if "map<" not in k and "variant" not in k]


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Union by name in which a new row replaces the old row of its key.

    Of several new rows of a key the last by `order` (arrival) stays; rows that tie there, or all without it, go by their other columns.
    """
    both = existing.withColumn("_prio", F.lit(0)).unionByName(new.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.col("_prio"), *[F.col(c) for c in order or []], *settled(both, [*keys, "_prio"])]).drop("_prio")


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key `existing` lacks. Nulls are keys too."""
    return new.alias("n").join(existing.select(*keys).distinct().alias("e"), _null_safe(keys, "n", "e"), "left_anti")


def only_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.alias("n").join(known.select(*keys).distinct().alias("e"), _null_safe(keys, "n", "e"), "left_semi")


def first_links(links: DataFrame, href: str, name: str, order: list[str], without: str | None = None) -> DataFrame:
    """Every address once, from its first link in `order`; links without an address or a name go, and those whose name holds `without`
    (the entry for the whole country, for instance), in any case."""
    ok = links.filter((F.trim(F.coalesce(name, F.lit(""))) != "") & (F.coalesce(href, F.lit("")) != ""))
    if without:
        ok = ok.filter(~F.lower(name).contains(without.lower()))
    return keep_one(ok, [href], [F.col(c) for c in order])


def by_priority(frames: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Union of named sources, in falling priority; for a key the first source that has it wins, and of its rows the least. Adds `source`."""
    tagged = [df.withColumn("source", F.lit(name)).withColumn("_prio", F.lit(i)) for i, (name, df) in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_one(both, keys, [F.col("_prio"), *settled(both, [*keys, "_prio"])]).drop("_prio")


def _null_safe(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
