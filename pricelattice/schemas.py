"""Declared schemas, one per source. Bronze keeps source types; Silver casts once."""

from __future__ import annotations

from pyspark.sql import types as T


#: Schema text by name. schemas.NAME gives the parsed StructType, which needs a running session.
DDL: dict[str, str] = {}
DEPOT_INFO = "struct<depotId:string,depotName:string,marketName:string,price:double,unitPrice:string,unitPriceValue:double,indexTime:string>"

DDL["RETAIL_RAW"] = (
    "id string, title string, brand string, refinedVolumeOrWeight string, categories array<string>, main_category string, "
    f"productDepotInfoList array<{DEPOT_INFO}>, _district string, _city string, _scraped_at string"
)
DDL["DEPOT"] = ("id string, name string, market string, lat double, lon double")
DDL["BBOX"] = ("key string, bbox array<double>")
DDL["FETCH_LOG"] = ("key string, total_pts int, failed_pts int, fail_rate double, depot_count int, status string")
DDL["WHOLESALE"] = ("tarih date, sehir string, urun string, kategori string, en_dusuk double, en_yuksek double, veri_turu string")
DDL["WHOLESALE_BRONZE"] = ("tarih string, sehir string, urun string, kategori string, en_dusuk string, en_yuksek string, veri_turu string")
DDL["MACRO"] = ("date string, value double, series string")
DDL["COMMODITY"] = (
    "date string, ticker string, commodity_name string, open double, high double, low double, close double, volume double, _ingested_at string"
)
DDL["ENERGY"] = ("timestamp string, _dataset string, _source string, _ingested_at string, contract string, mcp double, wap double, smp double")
DDL["NEWS"] = ("id string, date string, source string, url string, tone double, themes array<string>, _ingested_at string")
WEATHER_MEASURES = [
    "t2m_max", "t2m_min", "t2m", "t2mdew", "prectotcorr", "ws10m", "wd10m", "ws10m_max", "rh2m", "allsky_sfc_sw_dwn", "ps",
    "cloud_amt", "et0_fao_evapotranspiration", "soil_moisture_mm",
]
DDL["WEATHER_NESTED"] = (
    "city_id int, city_name string, region string, latitude string, longitude string, timestamp string, weather_data struct<"
    + ",".join(f"{m}:double" for m in WEATHER_MEASURES) + ">"
)
DDL["FUEL"] = ("Tarih string, il string, benzin double, motorin double, lpg double")
DDL["EVENT"] = ("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
DDL["RUN_LOG"] = ("ts timestamp, source string, bucket string, mb_before double, mb_after double, ratio double")


def __getattr__(name: str) -> T.StructType:
    if name in DDL:
        return T.StructType.fromDDL(DDL[name])
    raise AttributeError(name)


class SchemaDrift(ValueError):
    """A frame does not keep its declared contract."""


def enforce(df, schema: T.StructType):
    """Fails on missing or differently typed columns; extra columns are dropped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [f"{f.name}: {have.get(f.name, 'missing')}" for f in schema.fields if have.get(f.name) != f.dataType]
    if bad:
        raise SchemaDrift("; ".join(bad))
    return df.select(*[f.name for f in schema.fields])
