"""Macro series and futures: request windows, one row per date, wide frames of quotes to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelattice.operators.dedup import keep_one

# Days that one request may span, by the service's frequency number; 600 for others.
WINDOW_DAYS = {1: 600, 2: 800, 3: 6000, 4: 30000, 5: 27000, 6: 80000, 7: 160000, 8: 320000}
QUOTES = ["Open", "High", "Low", "Close", "Volume"]


def request_windows(df: DataFrame, lo: str, hi: str, frequency: Column) -> DataFrame:
    """[lo, hi] (dates) cut into windows that one request may span, without gap or overlap; none where lo is after hi."""
    days = F.coalesce(F.create_map(*[F.lit(x) for kv in WINDOW_DAYS.items() for x in kv])[frequency], F.lit(600))
    cut = df.filter(F.col(lo) <= F.col(hi)).withColumn("_days", days)
    many = F.floor(F.datediff(hi, lo) / F.col("_days")).cast("int")
    out = cut.withColumn("_i", F.explode(F.sequence(F.lit(0), many))).withColumn("window_start", F.date_add(lo, F.col("_i") * F.col("_days")))
    return out.withColumn("window_end", F.least(F.date_add("window_start", F.col("_days") - 1), F.col(hi))).drop("_i", "_days")


def tidy(chunks: DataFrame, arrival: str) -> DataFrame:
    """One row per (series, date) of the answers of many windows: the first to arrive. Rows without date or without a number go."""
    rows = chunks.withColumn("value", F.col("value").try_cast("double")).filter((F.col("date") != "") & F.col("value").isNotNull())
    return keep_one(rows, ["series", "date"], [F.col(arrival)])


def quote_rows(wide: DataFrame, names: dict[str, str], date: str, ingested_at: str) -> DataFrame:
    """Rows (date, ticker, commodity_name, open, high, low, close, volume, _ingested_at) of a frame with columns `<ticker>_<quote>`.
    Tickers without columns are passed over; days without a close have no row."""
    have = [t for t in names if f"{t}_Close" in wide.columns]
    one = lambda t: F.struct(F.lit(t).alias("ticker"), F.lit(names[t]).alias("commodity_name"), *[F.col(f"`{t}_{q}`").cast("double").alias(q.lower()) for q in QUOTES])
    if not have:
        raise ValueError("no ticker has a close column")
    rows = wide.select(F.date_format(date, "yyyy-MM-dd").alias("date"), F.explode(F.array(*[one(t) for t in have])).alias("_q"))
    return rows.select("date", "_q.*", F.lit(ingested_at).alias("_ingested_at")).filter(F.col("close").isNotNull() & ~F.isnan("close"))
