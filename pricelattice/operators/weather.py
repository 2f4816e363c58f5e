"""Weather Silver: nested record to daily row, unit changes, soil water."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.numeric import array_mean, first_item, hpa_to_kpa, mj_to_kwh, soil_m3_to_mm
from pricelattice.operators.windows import clamped_balance


def daily_from_api(df: DataFrame) -> DataFrame:
    """Daily scalars (first array item) and hourly means of an API answer, in table units."""
    return df.select(
        "city_id", "city_name",
        first_item(F.col("daily.temperature_2m_max")).alias("t2m_max"), first_item(F.col("daily.temperature_2m_min")).alias("t2m_min"),
        first_item(F.col("daily.precipitation_sum")).alias("prectotcorr"), mj_to_kwh(first_item(F.col("daily.shortwave_radiation_sum"))).alias("allsky_sfc_sw_dwn"),
        array_mean(F.col("hourly.wind_speed_10m")).alias("ws10m"), array_mean(F.col("hourly.relative_humidity_2m")).alias("rh2m"),
        hpa_to_kpa(array_mean(F.col("hourly.surface_pressure"))).alias("ps"), soil_m3_to_mm(array_mean(F.col("hourly.soil_moisture_0_to_7cm"))).alias("soil_moisture_mm"),
    )


def flatten_nested(df: DataFrame) -> DataFrame:
    return df.select("city_id", "city_name", "region", F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"), F.try_to_timestamp("timestamp").alias("time"), "weather_data.*")


def soil_moisture(df: DataFrame, by: list[str], at: str, rain: str, et0: str) -> DataFrame:
    """One chain per place across all years: 75 mm at the start, kept in [0, 150]."""
    return clamped_balance(df, by, at, F.col(rain) - F.col(et0))


def flags(df: DataFrame, tmin: str = "t2m_min", rain: str = "prectotcorr") -> DataFrame:
    return df.withColumn("frost", F.coalesce(F.col(tmin) <= 0, F.lit(False))).withColumn("heavy_rain", F.coalesce(F.col(rain) >= 20, F.lit(False)))
