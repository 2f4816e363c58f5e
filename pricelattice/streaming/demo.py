"""Event generators: JSON messages for each topic, on a stream of ticks or on any batch of (n, at).

Every value is a hash of its field and of n, so a tick gives the same message wherever and whenever it is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.streaming.streams import TOPICS

_SECOND, _DAY = "date_format(at, 'yyyy-MM-dd HH:mm:ss')", "date_format(at, 'yyyy-MM-dd')"


def _draw(field: str, below: int, per: int = 1, plus: int = 0) -> str:
    return f"pmod(xxhash64(n, '{field}'), {below}) / {per}.0D + {plus}"


def _name(field: str, below: int, prefix: str = "") -> str:
    return f"concat('{prefix}', pmod(xxhash64(n, '{field}'), {below}))"


# Milliseconds between messages, and the fields of each topic's message with their ranges.
PERIOD_MS = {"raw_market_prices": 200, "raw_hal_prices": 300, "raw_weather": 250, "raw_gdelt": 400, "raw_epias": 250, "raw_tcmb": 500, "raw_akaryakit": 300}
FIELDS = {
    "raw_market_prices": {
        "productId": _name("productId", 10000), "productName": "'Domates Sofralık'", "depotId": _name("depotId", 200, "dep-"), "district": "'Kadıköy'", "city": "'İstanbul'",
        "category": "'Sebze'", "price": _draw("price", 5000, 100), "currency": "'TRY'", "observedAt": _SECOND,
    },
    "raw_hal_prices": {
        "source": "'ibb_hal'", "kategori": "'Sebze'", "urun": "'Domates Sofralık'", "birim": "'Kg'", "en_dusuk": _draw("en_dusuk", 3000, 100), "en_yuksek": _draw("en_yuksek", 4000, 100, 10), "tarih": _DAY,
    },
    "raw_weather": {
        "source": "'open_meteo'", "lat": "36.8969D", "lon": "30.7133D", "region": "'Antalya'", "temperature_2m": _draw("temperature_2m", 400, 10, -5), "precipitation": _draw("precipitation", 50, 10),
        "soil_moisture": _draw("soil_moisture", 100, 100), "observedAt": _SECOND,
    },
    "raw_gdelt": {
        "source": "'gdelt'", "globalEventId": _name("globalEventId", 99999999), "theme": "'AGRICULTURE_FOOD'", "location": "'Turkey'", "tone": _draw("tone", 200, 10, -10),
        "sourceUrl": _name("sourceUrl", 10000, "https://example.tr/haber/"), "eventTime": _SECOND,
    },
    "raw_epias": {
        "source": "'epias'", "dataset": "'price_and_cost'", "hour": "date_format(at, 'HH:00')", "mcp": _draw("mcp", 500000, 100), "smp": _draw("smp", 500000, 100), "wap": _draw("wap", 500000, 100), "timestamp": _SECOND,
    },
    "raw_tcmb": {"source": "'tcmb_evds'", "series": "'TP.DK.USD.A.YTL'", "seriesName": "'usd_try_alis'", "value": _draw("value", 500, 10, 30), "date": _DAY},
    "raw_akaryakit": {"source": "'epdk'", "il": "'İstanbul'", "urun": "'Benzin'", "fiyat": _draw("fiyat", 1000, 10, 40), "birim": "'TL/L'", "tarih": _DAY},
}


def messages(ticks: DataFrame, topic: str) -> DataFrame:
    """key, value (JSON) of each tick (n, at)."""
    rows = ticks.selectExpr(*[f"{e} as {f}" for f, e in FIELDS[topic].items()])
    return rows.select(F.expr(TOPICS[topic]).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def stream(spark: SparkSession, topic: str, rows_per_second: int | None = None) -> DataFrame:
    """An endless stream of messages, by default at the topic's period (whole rows a second, at least one)."""
    rate = rows_per_second or max(1, round(1000 / PERIOD_MS[topic]))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return messages(ticks.select(F.col("value").alias("n"), F.col("timestamp").alias("at")), topic)
