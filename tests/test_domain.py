"""Hand-computed expectations: formats, merges, prices, weather, files and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelattice import schemas
from pricelattice.functions import dates as D
from pricelattice.functions import numeric as N
from pricelattice.functions import text as X
from pricelattice.operators import dedup, energy, gold, joins, pricing, reshape, weather, windows
from pricelattice.sources import readers, sinks
from pricelattice.streaming import streams


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_dates(spark):
    got = one(spark, *[D.any_date(F.lit(x)) for x in ("2024-1", "2024-10", "15-03-2024", "05.02.2024", "nonsense")])
    assert got == (dt.date(2024, 1, 1), dt.date(2024, 10, 1), dt.date(2024, 3, 15), dt.date(2024, 2, 5), None)
    c, bad = one(spark, D.contract_hour(F.lit("PH26042212")).cast("string"), D.contract_hour(F.lit("block")))
    assert one(spark, D.contract_hour(F.lit("PB26042212-03")).cast("string"))[0] == c
    assert (c, bad) == ("2026-04-22 09:00:00", None)
    assert one(spark, D.istanbul_iso(F.lit("2026-04-22 09:00:00").cast("timestamp")), D.prev_month(F.lit(1)), D.next_month(F.lit(12))) == ("2026-04-22T12:00:00+03:00", 12, 1)
    assert one(spark, F.add_months(F.lit("2024-01-31").cast("date"), 1)) == (dt.date(2024, 2, 29),)


def test_text(spark):
    assert one(spark, X.decimal_comma(F.lit("1.234,50")), X.decimal_comma(F.lit("12.5")), X.decimal_comma(F.lit("x"))) == (1234.5, 12.5, None)
    assert one(spark, X.per_base_unit(F.lit(12.0), F.lit("Peynir 500 gr"))) == (24.0,)
    assert one(spark, *X.price_range(F.lit("79,00 - 164,90"))) == (79.0, 164.9)
    assert one(spark, *[X.csv_field_double(F.lit(x)) for x in ("-4.5,1,2", "", "x")]) == (-4.5, None, None)
    assert one(spark, *X.split_composite(F.lit("Istanbul_Kadikoy_x"))) == ("Istanbul", "Kadikoy_x")
    assert one(spark, X.price_label(F.lit(1234.5)), X.path_safe(F.lit("a b/c")), X.norm_key(F.lit("  DOMATES   İri "))) == ("1234.50 ₺/Kg", "a_b-c", "domates iri")


def test_prices(spark):
    base = dt.date(2026, 4, 22)
    assert pricing.deflation_factor(base, base, {}) == 1.0
    assert pricing.deflation_factor(base, base - dt.timedelta(days=1), {2026: 0.365}) == pytest.approx(1 / 1.001)
    slow, day, k = 1.0, base - dt.timedelta(days=430), 0
    while day < base:  # day by day; 430 days never compound, since 29 remain after 401
        slow *= 1 + {2025: 0.4, 2026: 0.5}.get(day.year, 0.3) / 365
        day, k = day + dt.timedelta(days=1), k + 1
    assert pricing.deflation_factor(base, base - dt.timedelta(days=430), {2025: 0.4, 2026: 0.5}) == pytest.approx(1 / slow)
    assert pricing.season_curve([7, 8, 9, 10]) == [1.25] * 5 + [1.0] + [0.8] * 4 + [1.0, 1.25]
    noise = spark.range(2000).select(N.unit_noise(F.col("id")).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert 0.95 <= noise[0] and noise[1] <= 1.05
    rows = spark.createDataFrame([("1", "Domates", "d", 10.0), ("2", "x", "d", None)], "id string, title string, depotId string, price double")
    out = {r.id: r for r in pricing.backcast(rows, pricing.deflation_dim(spark, base, [dt.date(2026, 1, 5)], {2026: 0.3}), 4).collect()}
    assert out["2"].price is None and 0 < out["1"].price < 11 and out["1"].indexTime == "05.01.2026 08:00"


def test_margin_and_soil(spark):
    d = spark.createDataFrame([(10.0, 22.0), (10.0, 24.0), (10.0, 28.0)], "w double, r double")
    assert gold.sector_markup(d.withColumn("k", F.lit(1)), ["k"], "r", "w").first().avg_markup == pytest.approx(1.466667, abs=1e-6)
    s = spark.createDataFrame([(1, 1, 10.0, 0.0), (1, 2, 0.0, 200.0), (1, 3, 300.0, 0.0)], "c int, t int, rain double, et double")
    assert [r.state for r in weather.soil_moisture(s, ["c"], "t", "rain", "et").orderBy("t").collect()] == [85.0, 0.0, 150.0]


def test_merges(spark):
    a = spark.createDataFrame([("d1", None, 1), ("d2", 5, 2)], "date string, hour int, v int")
    b = spark.createDataFrame([("d1", None, 3)], "date string, hour int, v int")
    assert sorted(map(tuple, joins.merge_on_time(a, b).collect())) == [("d1", None, 1, 3), ("d2", 5, 2, None)]
    with pytest.raises(ValueError):
        joins.merge_on_time(a.select("v"), b.select("v"))
    once = dedup.upsert(a, b, ["date", "hour"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, dedup.upsert(once, b, ["date", "hour"]).collect()), key=str)
    e = spark.createDataFrame([("2026-01-01T10:00:00+03:00", "A", 1.0), ("2026-01-01T10:00:00+03:00", "B", 2.0), ("bad", "C", 3.0)], "date string, contract string, mcp double")
    n = energy.normalize(e, "x", "y", "z", keys=["contract"])
    assert n.columns[:4] == energy.LEADING and sorted(r.contract for r in n.collect()) == ["A", "B"]


def test_flatten_and_schema(spark):
    row = [("p1", "T", [{"depotId": "a", "price": 1.0}, {"depotId": "b", "price": None}]), ("p2", "U", []), ("p3", "V", None)]
    d = spark.createDataFrame(row, f"id string, title string, productDepotInfoList array<{schemas.DEPOT_INFO}>")
    assert sorted((r.id, r.depotId or "") for r in reshape.flatten_depots(d).collect()) == [("p1", "a"), ("p1", "b"), ("p2", ""), ("p3", "")]
    with pytest.raises(schemas.SchemaDrift):
        schemas.enforce(d, schemas.DEPOT)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"date": "2024-01-01", "value": 1.5, "series": "s"}\n\n{broken\n{"date": "2024-01-02", "value": 2, "series": "s"}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), schemas.MACRO)
    assert good.filter("date is not null").count() == 2 and bad.count() == 1
    (tmp_path / "c.csv").write_bytes("﻿ad,fiyat\nşeker,1\n".encode())
    (tmp_path / "d.csv").write_bytes("ad,fiyat\nşeker,2\n".encode("cp1254"))
    got = readers.read_csv_strings(spark, str(tmp_path / "*.csv"), ["ad", "fiyat"])
    assert sorted(map(tuple, got.collect())) == [("şeker", "1"), ("şeker", "2")]
    (tmp_path / "e.csv").write_bytes('fiyat,ad,yer\n"1,5","iki\nsatır ""x""",a\n3,çay,b\n'.encode())
    got = readers.read_csv(spark, str(tmp_path / "*.csv"), schemas.T.StructType.fromDDL("ad string, fiyat double"))
    assert sorted(map(tuple, got.collect()), key=str) == [("iki\nsatır \"x\"", None), ("çay", 3.0), ("şeker", 1.0), ("şeker", 2.0)]
    t = sinks.with_partitions(spark.createDataFrame([(1, "2024-04-05", 1), (2, "2024-05-05", 1)], "k int, d string, v int"), F.to_date("d"), ["year", "month"])
    path = str(tmp_path / "t")
    sinks.write_partitions(t, path, ["year", "month"])
    sinks.upsert_partitions(spark, t.filter("k = 1").withColumn("v", F.lit(9)), path, ["k"], ["year", "month"])
    sinks.write_missing_partitions(spark, t.withColumn("v", F.lit(7)), path, ["year", "month"])
    assert sorted((r.k, r.v, r.month) for r in sinks.table_or_none(spark, path).collect()) == [(1, 9, "04"), (2, 1, "05")]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    src.write.parquet(path)
    stream = streams.tumbling(streams.read_events(spark, path, src.schema), "ts", "1 day", ["event_type"], "value")
    q = stream.writeStream.format("memory").queryName("tumble").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (str(r.window_start), r.event_type, r.n)
    assert sorted(map(key, spark.table("tumble").collect())) == sorted(map(key, streams.tumbling(src, "ts", "1 day", ["event_type"], "value").collect()))


def test_scd2_is_disjoint(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "k int, t int, v string")
    rows = [tuple(r)[1:] for r in windows.scd2(d, ["k"], ["t"], "v", "t").orderBy("valid_from").collect()]
    assert rows == [("a", 1, 3, False), ("b", 3, 4, False), ("a", 4, None, True)]
