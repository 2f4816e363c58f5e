"""Ranks of keys with very many rows. A window puts a key's rows into one task; here a key is cut into ranges of the value, ranks are found
range by range and lifted by the sizes of the ranges before.

Ranges come from the value alone (steps of a logarithm around 0), not from a sample, so they are the same wherever they are worked out.
Rows of one value share a range: a value that a large part of a key's rows have is one task's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each doubling of 1 + |value|.
STEPS = 128


def value_range(value: Column) -> Column:
    """A number that rises with the value; null and NaN have their own, first and last as in an ascending sort."""
    v = value.cast("double")
    return F.when(v.isNull(), F.lit(-(1 << 40))).when(F.isnan(v), F.lit(1 << 40)).otherwise(F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * STEPS)).cast("bigint")


def ranked(df: DataFrame, by: list[str], value: str, ties: list[str] | None = None) -> DataFrame:
    """Adds _rank (rank by value and ties), _row (row number; equal rows in any order), _dense (dense rank by the value alone) and _total
    (rows of the key), as window functions over the whole key would."""
    order = [F.col(value), *[F.col(t) for t in ties or []]]
    rows = df.withColumn("_b", value_range(F.col(value)))
    sums = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), (F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("_d"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.coalesce(F.sum("_d").over(w), F.lit(0)).alias("_distinct"), F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_b") == F.col("_c"))
    own = Window.partitionBy(*by, "_b")
    out = rows.join(sums, on).withColumn("_rank", F.col("_before") + F.rank().over(own.orderBy(*order))).withColumn("_row", F.col("_before") + F.row_number().over(own.orderBy(*order)))
    return out.withColumn("_dense", F.col("_distinct") + F.dense_rank().over(own.orderBy(value))).drop("_b", "_c", "_before", "_distinct", *[f"_k{i}" for i in range(len(by))])


def tile(n: int, row: Column, total: Column) -> Column:
    """ntile(n) of a row number among `total` rows: the first total mod n tiles have a row more."""
    small, more = F.floor(total / n), total % n
    cut = more * (small + 1)
    return F.when(row <= cut, F.floor((row - 1) / (small + 1)) + 1).otherwise(more + F.floor((row - 1 - cut) / F.greatest(small, F.lit(1))) + 1).cast("int")


def percent(rank: Column, total: Column) -> Column:
    """percent_rank() of a rank."""
    return F.when(total > 1, (rank - 1) / (total - 1)).otherwise(0.0)
