"""Gold-tier measures: margin, inequality, cube, shock lag, asymmetric pass-through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.functions.numeric import markup


def sector_markup(df: DataFrame, by: list[str], retail: str, wholesale: str) -> DataFrame:
    """Mean of the ratios, not the ratio of means."""
    return df.withColumn("_m", markup(F.col(retail), F.col(wholesale))).groupBy(*by).agg(F.avg("_m").alias("avg_markup"), F.count("_m").alias("n"))


def inequality(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Coefficient of variation (sample standard deviation) and group mean against the overall mean, which comes from sums."""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("_sd"), F.sum(value).alias("_s"), F.count(value).alias("n"))
    total = g.agg((F.sum("_s") / F.sum("n")).alias("_overall"))
    out = g.crossJoin(F.broadcast(total))  # one row
    return out.select(*by, "mean_value", (F.col("_sd") / F.col("mean_value")).alias("cv"), (F.col("mean_value") / F.col("_overall")).alias("expensiveness"), "n")


def cube(df: DataFrame, dims: list[str], **aggs: Column) -> DataFrame:
    return df.cube(*dims).agg(F.grouping_id().cast("bigint").alias("grouping_id"), *[c.alias(n) for n, c in aggs.items()])


def rollup(df: DataFrame, dims: list[str], **aggs: Column) -> DataFrame:
    return df.rollup(*dims).agg(F.grouping_id().cast("bigint").alias("grouping_id"), *[c.alias(n) for n, c in aggs.items()])


def lag_correlation(series: DataFrame, at: str, cause: str, effect: str, lags: range, by: list[str] | None = None) -> DataFrame:
    """Correlation of cause[t] with effect[t + lag] for each lag: the daily series is exploded by lag, one shuffle."""
    keys = by or []
    c = series.select(*keys, F.explode(F.array(*[F.lit(i) for i in lags])).alias("lag"), F.col(at).alias("_d"), F.col(cause).alias("_c")).withColumn(at, F.date_add("_d", F.col("lag")))
    e = series.select(*keys, at, F.col(effect).alias("_e"))
    return c.join(e, [*keys, at]).groupBy(*keys, "lag").agg(F.corr("_c", "_e").alias("corr"), F.count("*").alias("n"))


def best_lag(corrs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The lag of the strongest correlation; the smaller one on ties."""
    keys = by or []
    return corrs.filter("corr is not null").groupBy(*keys).agg(F.min_by("lag", F.struct((-F.abs("corr")).alias("a"), F.col("lag").alias("b"))).alias("best_lag"))


def asymmetry(df: DataFrame, by: list[str], order: list[str], wholesale: str, retail: str) -> DataFrame:
    """Mean retail response to wholesale rises and falls, and asymmetry = |up| / |down| - 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    dw = F.col(wholesale) / F.lag(wholesale).over(w) - 1
    dr = F.col(retail) / F.lag(retail).over(w) - 1
    d = df.withColumn("_dw", dw).withColumn("_dr", dr).filter("_dw is not null and _dw <> 0")
    g = d.groupBy(*by).agg(
        F.avg(F.when(F.col("_dw") > 0, F.col("_dr") / F.col("_dw"))).alias("up_speed"), F.avg(F.when(F.col("_dw") < 0, F.col("_dr") / F.col("_dw"))).alias("down_speed")
    )
    return g.withColumn("asymmetry", F.when(F.abs("down_speed") > 0, F.abs("up_speed") / F.abs("down_speed") - 1))


def regression(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def lagged_regression(df: DataFrame, by: list[str], order: list[str], y: str, x: str, lag: int) -> DataFrame:
    """Regression of y on x of the row `lag` before."""
    before = F.lag(x, lag).over(Window.partitionBy(*by).orderBy(*order))
    return regression(df.withColumn("_x", before).filter("_x is not null"), by, y, "_x")


def median_index(df: DataFrame, period: str, value: str, base: int) -> DataFrame:
    """Median of each period over the median of the base period."""
    m = df.groupBy(period).agg(F.median(value).alias("median_value"))
    b = m.filter(F.col(period) == base).select(F.col("median_value").alias("_b"))
    return m.join(F.broadcast(b), F.lit(True), "left").select(period, "median_value", (F.col("median_value") / F.col("_b")).alias("price_index"))


def completeness(df: DataFrame, fetched: str, expected: str, share: float = 0.95) -> DataFrame:
    return df.withColumn("complete", F.coalesce(F.col(fetched) >= share * F.col(expected), F.lit(False)))


def failure_status(df: DataFrame, failed: str, total: str, limit: float = 0.05) -> DataFrame:
    rate = F.when(F.col(total) > 0, F.col(failed) / F.col(total)).otherwise(F.lit(1.0))
    return df.withColumn("fail_rate", rate).withColumn("status", F.when(rate < limit, "OK").otherwise("INCOMPLETE"))
