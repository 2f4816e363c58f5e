"""The speed layer: weather messages cleaned, converted and flagged, joined with the prices of the hours after them and with the table of
places. The same function runs over tables, which is its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.functions.numeric import hpa_to_kpa, mj_to_kwh
from pricelattice.operators.weather import flags

#: Rows of the table of places up to which it is broadcast.
PLACES_BROADCAST = 100_000


def clean(weather: DataFrame) -> DataFrame:
    """Rows with a place and a time; NaN and impossible values are null; pressure in kPa, radiation in kWh; frost and heavy rain flagged.

    Columns: city_id, at, t2m_min, t2m_max (degrees), rain (mm), pressure (hPa), radiation (MJ).
    """
    number = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    within = lambda c, lo, hi: F.when(F.col(c).between(lo, hi), F.col(c))
    w = weather.filter("city_id is not null and at is not null").withColumns({c: number(c) for c in ("t2m_min", "t2m_max", "rain", "pressure", "radiation")})
    w = w.withColumns({"t2m_min": within("t2m_min", -90, 60), "t2m_max": within("t2m_max", -90, 60), "rain": within("rain", 0, 2000), "pressure": within("pressure", 300, 1100), "radiation": within("radiation", 0, 60)})
    w = w.filter("t2m_min is not null or t2m_max is not null or rain is not null")
    low, high = F.least("t2m_min", "t2m_max"), F.greatest("t2m_min", "t2m_max")
    w = w.select("city_id", F.col("at").alias("weather_at"), low.alias("t2m_min"), high.alias("t2m_max"), "rain", hpa_to_kpa(F.col("pressure")).alias("ps"), mj_to_kwh(F.col("radiation")).alias("allsky_sfc_sw_dwn"))
    return flags(w, "t2m_min", "rain")


def with_prices(weather: DataFrame, prices: DataFrame, hours: int = 6, delay: str = "48 hours") -> DataFrame:
    """Cleaned weather beside every price (city_id, price_at, price) of its place from its time to less than `hours` later. On streams both
    sides have a watermark and the interval bounds the state, so rows leave it when no partner can come."""
    if weather.isStreaming:
        weather, prices = weather.withWatermark("weather_at", delay), prices.withWatermark("price_at", delay)
    p = prices.select(F.col("city_id").alias("_city"), "price_at", "price")
    near = (F.col("city_id") == F.col("_city")) & (F.col("price_at") >= F.col("weather_at")) & (F.col("price_at") < F.col("weather_at") + F.expr(f"interval {hours} hours"))
    return weather.join(p, near).drop("_city")


def speed_layer(weather: DataFrame, prices: DataFrame, places: DataFrame, hours: int = 6, delay: str = "48 hours", places_rows: int | None = None) -> DataFrame:
    """with_prices() and the columns of `places` (city_id, ...), a table. It is broadcast if the caller states places_rows and they are few;
    else Spark chooses by its statistics. Places that the table lacks keep their rows, with nulls."""
    small = places_rows is not None and places_rows <= PLACES_BROADCAST
    return with_prices(clean(weather), prices, hours, delay).join(F.broadcast(places) if small else places, "city_id", "left")
