"""Approximate aggregates that are stored and merged: HyperLogLog sketches of distinct values, KLL sketches of quantiles.

A sketch row stands for one group of one partition. Queries merge the rows of the partitions that they ask for; no fact row is read
again, and a new day adds its rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
#: Relative standard error of a HyperLogLog sketch of 2^LG_K buckets, and the rank error that a KLL sketch of KLL_K keeps in 99 of 100.
HLL_ERROR, KLL_ERROR = 1.04 / 2 ** (LG_K / 2), 0.01


def sketched(df: DataFrame, by: list[str], distinct: str, measure: str) -> DataFrame:
    """by, n, hll (of `distinct`), kll (of `measure` as double). Nulls are not counted."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(distinct), F.lit(LG_K)).alias("hll"), F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(KLL_K)).alias("kll"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones or of partitions."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll", F.lit(KLL_K)).alias("kll"))


def estimates(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """by, n, distinct_estimate, and q<percent> for each quantile."""
    q = [F.kll_sketch_get_quantile_double("kll", F.lit(x)).alias(f"q{round(100 * x)}") for x in quantiles]
    return sketches.select(*by, "n", F.hll_sketch_estimate("hll").alias("distinct_estimate"), *q)
