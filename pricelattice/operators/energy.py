"""Normalisation of energy datasets: time column, zone, order, last row of a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.dates import any_timestamp, contract_hour, istanbul_iso
from pricelattice.operators.dedup import keep_last, keep_one, settled
from pricelattice.operators.joins import full_outer_null_safe

# Time columns in order of preference.
TIME_COLUMNS = ["timestamp", "dt", "date", "gasDay", "period"]
LEADING = ["timestamp", "_dataset", "_source", "_ingested_at"]


def time_column(columns: list[str]) -> str:
    for c in TIME_COLUMNS:
        if c in columns:
            return c
    raise ValueError(f"no time column among {columns}")


def normalize(df: DataFrame, dataset: str, source: str, ingested_at: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """UTC instant, Istanbul text, enrichment, leading columns first; rows without a readable time go. One row per (timestamp, keys).

    `keys` names what else tells rows of one timestamp apart (contract, dam, plant), so rows of different things are never merged. The last
    row by `order` stays; rows that tie there, or all without it, go by their other columns.
    """
    at = time_column(df.columns)
    out = df.withColumn("_at", any_timestamp(F.col(at).cast("string"))).filter("_at is not null")
    out = out.drop(*{at, "hour"}).withColumn("timestamp", istanbul_iso(F.col("_at")))
    out = out.withColumns({"_dataset": F.lit(dataset), "_source": F.lit(source), "_ingested_at": F.lit(ingested_at)})
    out = out.select(*LEADING, *[c for c in out.columns if c not in {*LEADING, "_at"}])
    own = ["timestamp", *(keys or [])]
    return keep_last(out, own, [*[F.col(c) for c in order or []], *settled(out, own)])


def parse_contracts(df: DataFrame, name: str = "kontratAdi") -> DataFrame:
    """Adds the contract's hour; rows of other shapes go only if some row has the shape (one bounded look)."""
    out = df.withColumn("timestamp", contract_hour(F.col(name)))
    return out.filter("timestamp is not null") if out.filter("timestamp is not null").limit(1).count() else out


def with_contract_hour(df: DataFrame, name: str = "kontratAdi") -> DataFrame:
    """Rows of contracts with an hour in their name, which becomes `date`, the UTC instant as text."""
    at = contract_hour(F.col(name))
    return df.filter(at.isNotNull()).withColumn("date", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def outage_times(df: DataFrame) -> DataFrame:
    return df.drop("date").withColumnRenamed("startTime", "timestamp")


def intraday(prices: DataFrame, volumes: DataFrame) -> DataFrame:
    keys = [k for k in ("date", "kontratTuru", "kontratAdi") if k in prices.columns and k in volumes.columns]
    joined = full_outer_null_safe(prices, volumes, keys)
    order = settled(joined, keys)  # of rows of one contract the least by the other columns stays
    return keep_one(joined, keys, order) if order else joined.dropDuplicates(keys)
