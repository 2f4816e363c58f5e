"""The energy datasets: what each is asked for, the typed fields it answers, its keys, and how its answers become rows.

One DataSource serves them all. A partition is one call over one request window; it hands on the records as JSON text. Typing is done by
typed() on columns: a record with a field that is not declared, a value of another type or no time goes to quarantine with the reason.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pricelattice.operators import energy
from pricelattice.operators.joins import merge_on_time


@dataclass(frozen=True)
class Dataset:
    """calls: request names, answered by `fields` each (SQL types by name); keys: what tells rows of one timestamp apart. shape: 'range'
    asks windows of `months`, 'period' the first day of each month, 'snapshot' once, without dates. overlap_h: hours read again."""

    calls: dict[str, str]
    keys: tuple[str, ...] = ()
    months: int = 12
    shape: str = "range"
    overlap_h: int = 48


def _doubles(*names: str) -> str:
    return ", ".join(f"{n} double" for n in names)


_HOUR = "date string, hour string, "
_DAM = "date string, basinName string, damName string, "
_OUTAGE = "id bigint, date string, startTime string, endTime string, province string, district string, distributionCompanyName string, reason string, effectedNeighbourhoods string, "
# The datasets' calls, fields, months that one request may span, and hours that are read again.
DATASETS: dict[str, Dataset] = {
    "price_and_cost": Dataset({"price-and-cost": "timestamp string, contract string, system_direction string, " + _doubles("mcp", "wap", "smp", "pos_imb_price", "neg_imb_price", "kupst_cost")}, ("contract",)),
    "consumption": Dataset({"consumption-forecast": "dt string, contract string, " + _doubles("load_plan", "uecm", "rt_cons", "consumption")}, ("contract",)),
    "real_time_generation": Dataset({"rt-gen": _HOUR + _doubles("total", "naturalGas", "dammedHydro", "lignite", "river", "importCoal", "wind", "sun", "fueloil", "geothermal", "asphaltiteCoal", "blackCoal", "biomass", "naphta", "lng", "importExport", "wasteheat")}, months=3),
    "injection_quantity": Dataset({"uevm": _HOUR + _doubles("total", "naturalGas", "dam", "lignite", "importedCoal", "wind", "sun")}, months=3),
    "renewable_injection_quantity": Dataset({"ren-uevm": _HOUR + _doubles("toplam", "ruzgar", "jeotermal", "rezervuarli", "gunes", "biyokutle")}, months=3),
    "wind_forecast": Dataset({"wind-forecast": _HOUR + _doubles("generation", "forecast", "quarter1", "quarter2", "quarter3", "quarter4")}, months=1),
    "renewable_unit_cost": Dataset({"ren-unit-cost": "period string, version string, " + _doubles("supplierUnitCost", "unitCost", "ptf")}, ("version",)),
    "renewable_total_cost": Dataset({"ren-total-cost": "period string, version string, " + _doubles("toplam", "ruzgar", "gunes", "jeotermal", "biyokutle")}, ("version",)),
    "zero_balance_adjustment": Dataset({"zero-balance": "period string, " + _doubles("zeroBalanceAdjustment", "downRegulation", "upRegulation", "negativeImbalance", "kupst")}),
    "transmission_loss_factor": Dataset({"iskk": "period string, " + _doubles("firstVersionValue", "lastVersionValue", "difference")}),
    "primary_frequency_capacity": Dataset({"anc-pf-qty": _HOUR + "amount double", "anc-pfk": _HOUR + "price double"}),
    "secondary_frequency_capacity": Dataset({"anc-sf-qty": _HOUR + "amount double", "anc-sfk": _HOUR + "price double"}),
    "mcp_smp_imbalance": Dataset({"mcp-smp-imb": _HOUR + "systemStatus string, " + _doubles("ptf", "smf", "positiveImbalance", "negativeImbalance")}),
    "natural_gas_spot": Dataset({"ng-spot-prices": "gasDay string, contractName string, state string, " + _doubles("dayAheadPrice", "intraDayPrice", "dayAfterPrice", "weightedAverage")}, ("contractName",)),
    "natural_gas_balancing": Dataset({"ng-balancing-price": "gasDay string, " + _doubles("additionalBalancingBuyPrice", "additionalBalancingSellPrice", "balancingPrice")}),
    "intraday_market": Dataset({"idm-qty": "kontratTuru string, kontratAdi string, " + _doubles("clearingQuantityAsk", "clearingQuantityBid"), "idm-volume": "kontratTuru string, kontratAdi string, volume double"}, ("kontratTuru", "kontratAdi"), months=3),
    "dam_daily_level": Dataset({"dams-daily-level": _DAM + _doubles("maxWaterLevel", "currentLevel", "minWaterLevel")}, ("basinName", "damName"), 999, "snapshot", 0),
    "dam_active_fullness": Dataset({"dams-active-fullness": _DAM + "activeFullness double"}, ("basinName", "damName"), 999, "snapshot", 0),
    "planned_outages": Dataset({"planned-outages": _OUTAGE + "numberOfSubscribers bigint"}, ("id",), 1, "period", 0),
    "unplanned_outages": Dataset({"unplanned-outages": _OUTAGE + "numberOfSubscribers bigint"}, ("id",), 1, "period", 0),
    "dam_volume": Dataset({"dam-volume": _HOUR + _doubles("volumeOfAsk", "volumeOfBid", "volume")}),
    "realtime_consumption": Dataset({"rt-cons": "date string, time string, consumption double"}, months=3),
    "renewable_realtime_generation": Dataset({"ren-rt-gen": _HOUR + "plantId bigint, plantName string, " + _doubles("toplam", "ruzgar", "jeotermal", "rezervuarli", "kanalTipi", "nehirTipi", "copGazi", "biyogaz", "gunes", "biyokutle", "diger")}, ("plantId",), 1),
    "kgup": Dataset({"kgup": "date string, time string, plantId bigint, " + _doubles("toplam", "dogalgaz", "ruzgar", "linyit", "tasKomur", "ithalKomur", "fuelOil", "jeotermal", "barajli", "nafta", "biokutle", "akarsu", "gunes", "diger")}, ("plantId",), 3),
    "dam_active_volume": Dataset({"dams-active-volume": _DAM + "activeVolume double"}, ("basinName", "damName"), 999, "snapshot", 0),
    "natural_gas_daily_transmission": Dataset({"ng-tr-daily-transmission": "gasDay string, " + _doubles("injection", "reproduction")}),
}
TIMES = ("timestamp", "dt", "date", "gasDay", "period", "kontratAdi", "startTime")


def _names(ddl: str) -> list[str]:
    return [p.split()[0] for p in ddl.split(", ")]


def _after(day: date, months: int) -> date:
    """The first day of a window that many months on; days that a month lacks become its last."""
    y, m = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(day.day, last))


def windows(spec: Dataset, start: date, end: date) -> list[tuple[str, str]]:
    """Request windows (first day, last day) of a range of days."""
    if spec.shape == "snapshot":
        return [("", "")]
    at = start.replace(day=1) if spec.shape == "period" else start
    out = []
    while at <= end:
        following = _after(at, spec.months)
        out.append((at.isoformat(), min(following - timedelta(days=1), end).isoformat()))
        at = following
    return out


def landed_schema(name: str) -> T.StructType:
    """Schema of a dataset's normalised rows as landed: the leading columns, then the fields of all its calls but times and hours."""
    fields = {f.name: f for ddl in DATASETS[name].calls.values() for f in T.StructType.fromDDL(ddl).fields}
    rest = [f for n, f in fields.items() if n not in {"timestamp", "dt", "date", "gasDay", "period", "startTime", "hour", "time"}]
    return T.StructType([*[T.StructField(c, T.StringType()) for c in energy.LEADING], *rest])


class Request(InputPartition):
    def __init__(self, call: str, lo: str, hi: str):
        self.call, self.lo, self.hi = call, lo, hi


class EnergyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self):
        spec = DATASETS[self.o["dataset"]]
        spans = windows(spec, date.fromisoformat(self.o["start"]), date.fromisoformat(self.o["end"]))
        return [Request(call, lo, hi) for call in spec.calls for lo, hi in spans]

    def read(self, r: Request):
        module, _, name = self.o["fetch"].partition(":")
        fetch, tries = getattr(importlib.import_module(module), name), int(self.o.get("retries", "3"))
        for attempt in range(tries):
            try:
                records = list(fetch(r.call, r.lo, r.hi))
                break
            except OSError:
                if attempt + 1 == tries:
                    raise
        for rec in records:
            yield (r.call, r.lo, r.hi, json.dumps(rec, ensure_ascii=False))


class EnergySource(DataSource):
    """Options: dataset, start, end (ISO days), fetch ('module:function' of call, first day, last day, giving dicts), retries."""

    @classmethod
    def name(cls):
        return "energy_api"

    def schema(self):
        return "call string, lo string, hi string, record string"

    def reader(self, schema):
        return EnergyReader(dict(self.options))


def records(spark: SparkSession, name: str, start: str, end: str, fetch: str, retries: int = 3) -> DataFrame:
    """call, lo, hi, record. Land this table before it is used twice: each use asks again."""
    spark.dataSource.register(EnergySource)
    o = {"dataset": name, "start": start, "end": end, "fetch": fetch, "retries": str(retries)}
    return spark.read.format("energy_api").options(**o).load()


def drift(record: Column, ddl: str, value: Column, texts: Column, keys: Column) -> Column:
    """What is wrong with a record, or null: no object, unknown fields, values of another type, no time. `value`, `texts` and `keys` are
    the record read as its fields, as texts by name and as its names, once each."""
    names = _names(ddl)
    unknown = F.array_except(keys, F.array(*map(F.lit, names)))
    stated = lambda n: F.when(texts.isNotNull(), texts[n]).otherwise(F.get_json_object(record, f"$.{n}")).isNotNull()
    wrong = F.array_compact(F.array(*[F.when(stated(n) & value[n].isNull(), F.lit(n)) for n in names]))
    timed = F.coalesce(*[value[n] for n in TIMES if n in names]).isNotNull()
    return (
        F.when(keys.isNull(), "no object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ",")))
        .when(F.size(wrong) > 0, F.concat(F.lit("type: "), F.array_join(wrong, ",")))
        .when(~timed, "no time")
    )


def typed(raw: DataFrame, name: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """({call: typed rows}, quarantine with call, record and drift) of a table of call and record. Calls that the dataset lacks are drift."""
    spec = DATASETS[name]
    read = [F.when(F.col("call") == call, F.from_json("record", ddl)).alias(f"_v{i}") for i, (call, ddl) in enumerate(spec.calls.items())]
    read += [F.from_json("record", "map<string,string>").alias("_texts"), F.json_object_keys("record").alias("_keys")]
    # inline() keeps what is read apart from the filters that ask it: a plain column would be read again for each field that they name.
    judged = raw.select("call", "record", F.inline(F.array(F.struct(*read))))
    fault = F.lit("unknown call")
    for i, (call, ddl) in enumerate(spec.calls.items()):
        fault = F.when(F.col("call") == call, drift(F.col("record"), ddl, F.col(f"_v{i}"), F.col("_texts"), F.col("_keys"))).otherwise(fault)
    judged = judged.withColumn("drift", fault)
    good = judged.filter("drift is null")
    rows = {call: good.filter(F.col("call") == call).select(f"_v{i}.*") for i, call in enumerate(spec.calls)}
    return rows, judged.filter("drift is not null").select("call", "record", "drift")


def dataset(raw: DataFrame, name: str, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): answers of a dataset's calls merged on time, or on the contract; times normalised; one row a key."""
    spec = DATASETS[name]
    by_call, bad = typed(raw, name)
    frames = list(by_call.values())
    if name == "intraday_market":
        # The hour is in the contract's name; contracts of other shapes have no time and go.
        out = energy.intraday(*[energy.with_contract_hour(f) for f in frames])
    elif len(frames) > 1:
        out = merge_on_time(*frames)
    else:
        out = frames[0]
    if spec.shape == "period":
        out = energy.outage_times(out)
    if "time" in out.columns and "hour" not in out.columns:
        out = out.drop("time")
    return energy.normalize(out, name, "epias", ingested_at, list(spec.keys)), bad
