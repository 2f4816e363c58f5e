"""Named sources: what each dataset reads, how it is keyed and how far one request may span."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pricelattice import schemas
from pricelattice.sources import datasets


@dataclass
class SourceSpec:
    name: str
    schema: str
    partition: list[str]
    keys: list[str]
    max_range_months: int = 12
    reader: object = None
    options: dict = field(default_factory=dict)


REGISTRY: dict[str, SourceSpec] = {}
def register(spec: SourceSpec) -> SourceSpec:
    REGISTRY[spec.name] = spec
    return spec


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    from pricelattice.sources.readers import read_jsonl

    spec = REGISTRY[name]
    return spec.reader(spark, path) if spec.reader else read_jsonl(spark, path, getattr(schemas, spec.schema))[0]


for _name, _schema, _part, _keys in [
    ("market", "RETAIL_RAW", ["year", "month", "day"], ["id"]), ("hal_all", "WHOLESALE_BRONZE", ["year", "month"], ["tarih", "sehir", "urun"]),
    ("gdelt", "NEWS", ["year", "month", "day"], ["id"]), ("akaryakit", "FUEL", ["year", "month", "day"], ["Tarih", "il"]),
    ("commodities", "COMMODITY", ["year", "month"], ["date", "ticker"]), ("tcmb", "MACRO", ["year", "month"], ["series", "date"]),
    ("weather", "WEATHER_NESTED", ["year", "month"], ["city_id", "timestamp"]),
]:
    register(SourceSpec(_name, _schema, _part, _keys))


def _landed(name: str):
    """Reader of a dataset's landed JSON lines: normalised rows with its declared fields."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        from pricelattice.sources.readers import read_jsonl

        return read_jsonl(spark, path, datasets.landed_schema(name))[0]

    return read


for _name, _spec in datasets.DATASETS.items():
    register(SourceSpec(f"epias/{_name}", f"epias/{_name}", ["year", "month"], ["timestamp", *_spec.keys], _spec.months, _landed(_name)))
