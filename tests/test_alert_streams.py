"""Alerts and the speed layer run as streams and held against their batch twins; sources and sinks that had no test."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricelattice import schemas
from pricelattice.operators import weather
from pricelattice.plans import extended
from pricelattice.sources import paged, readers, sinks
from pricelattice.streaming import alerts, speed, streams

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(alerts.STATE_STORE[0])
    spark.conf.set(*alerts.STATE_STORE)
    yield
    spark.conf.set(alerts.STATE_STORE[0], before)


def prices(spark, rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), p) for k, h, p in rows], "k string, at timestamp, price double")


def ran(stream, name, tmp_path, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def alert_rows(df):
    return sorted((r.k, r["at"], r.prev_retail, r.retail, r.prev_wholesale, r.wholesale) for r in df.collect())


RETAIL = [("a", 0, 10.0), ("a", 5, 16.0), ("a", 9, 30.0), ("a", 70, 90.0), ("b", 1, 10.0), ("b", 2, 20.0), ("c", 1, 10.0), ("c", 3, 20.0), ("a", 5, 15.5), ("d", 4, 5.0), ("d", 6, None)]
WHOLESALE = [("a", 0, 5.0), ("a", 4, 5.1), ("a", 9, 9.0), ("b", 0, 5.0), ("b", 2, 5.0), ("c", 2, 5.0), ("d", 0, 1.0)]
LAST = [("z", 500, 1.0)]  # moves the watermark past everything


def test_jump_alerts_by_hand(spark):
    got = alert_rows(alerts.jumps_batch(prices(spark, RETAIL), prices(spark, WHOLESALE), "k", "at", "price"))
    at = lambda h: T0 + dt.timedelta(hours=h)
    # a at 5: 10 to 15.5, wholesale 5 to 5.1. At 9 wholesale moved; at 70 the price before is too old. b doubled over a flat price; c had no wholesale price before.
    assert got == [("a", at(5), 10.0, 15.5, 5.0, 5.1), ("b", at(2), 10.0, 20.0, 5.0, 5.0)]


def test_jump_stream_equals_batch(spark, rocks, tmp_path):
    """Rows in several files, out of order within the delay; alerts come as the watermark passes."""
    r, w = prices(spark, [*RETAIL, *LAST]), prices(spark, [*WHOLESALE, *LAST])
    want = alert_rows(alerts.jumps_batch(r, w, "k", "at", "price"))
    for name, d in (("r", r), ("w", w)):
        d.repartition(3, "price").write.parquet(str(tmp_path / name))
    read = lambda n: streams.read_events(spark, str(tmp_path / n), r.schema)
    out = alerts.jumps_stream(read("r"), read("w"), "k", "at", "price", delay="1000 hours")
    assert ran(out, "nothing_yet", tmp_path, spark).count() == 0  # the watermark has passed no row
    out = alerts.jumps_stream(read("r"), read("w"), "k", "at", "price", delay="1 second")
    assert alert_rows(ran(out, "jumps", tmp_path, spark)) == want


def test_late_prices_and_expiry(spark, rocks, tmp_path):
    """One file a batch: a price older than the watermark is not looked at, and a retail price is forgotten after 48 hours."""
    r = [[("a", 0, 10.0)], [("a", 100, 10.0)], [("a", 1, 50.0), ("a", 101, 16.0)], [("a", 300, 40.0)], LAST]
    w = [[("a", 0, 5.0)], [("a", 99, 5.0)], [("a", 101, 5.0)], [("a", 299, 5.0)], LAST]
    for name, batches in (("r", r), ("w", w)):
        for i, rows in enumerate(batches):
            prices(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"b={i}"))
    schema = prices(spark, r[0]).schema

    def one_by_one(n):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / n / "b=*"))

    got = alert_rows(ran(alerts.jumps_stream(one_by_one("r"), one_by_one("w"), "k", "at", "price", delay="1 hour"), "late", tmp_path, spark))
    assert got == [("a", T0 + dt.timedelta(hours=101), 10.0, 16.0, 5.0, 5.0)]


def test_speed_layer_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    w = extended.weather_of(e)
    p = e.filter("event_type = 'purchase'").selectExpr("user_id as city_id", "cast(ts as timestamp) as price_at", "value as price")
    places = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").alias("city_id"), F.col("c_mktsegment").alias("segment"))
    w.repartition(2).write.parquet(str(tmp_path / "w"))
    p.repartition(2).write.parquet(str(tmp_path / "p"))
    live = speed.speed_layer(streams.read_events(spark, str(tmp_path / "w"), w.schema), streams.read_events(spark, str(tmp_path / "p"), p.schema), places, places_rows=places.count())
    rows = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    batch = rows(speed.speed_layer(w, p, places))
    assert live.isStreaming and rows(ran(live, "speed", tmp_path, spark)) == batch and len(batch) > 10


def test_weather_cleaning(spark):
    nan = float("nan")
    rows = [(1, T0, 5.0, -3.0, 25.0, 1013.0, 7.2), (1, T0, nan, 2.0, -5.0, 5.0, None), (None, T0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, T0, None, nan, None, 1000.0, 3.6), (3, T0, 99.0, 10.0, 19.9, 1000.0, 3.6)]
    got = {r.city_id: r for r in speed.clean(spark.createDataFrame(rows[:1] + rows[2:], "city_id int, at timestamp, t2m_min double, t2m_max double, rain double, pressure double, radiation double")).collect()}
    assert set(got) == {1, 3} and (got[1].t2m_min, got[1].t2m_max, got[1].ps, got[1].allsky_sfc_sw_dwn, got[1].frost, got[1].heavy_rain) == (-3.0, 5.0, 101.3, 2.0, True, True)
    assert (got[3].t2m_min, got[3].frost, got[3].heavy_rain) == (10.0, False, False)
    odd = speed.clean(spark.createDataFrame(rows[1:2], "city_id int, at timestamp, t2m_min double, t2m_max double, rain double, pressure double, radiation double")).first()
    assert (odd.t2m_min, odd.rain, odd.ps, odd.allsky_sfc_sw_dwn) == (2.0, None, None, None)


# ---- sources and sinks


def test_paged_source(spark):
    paged.register(spark)
    r = spark.read.format("paged_rest").option("fetch", "tests.fake_transport:paged").option("windows", "a/b;c/d").option("ddl", "id int, window string").load()
    rows = r.collect()
    assert len(rows) == 120 and {x.window for x in rows} == {"a", "c"} and len({(x.id, x.window) for x in rows}) == 120


def test_quarantine_sink(spark, tmp_path):
    lines = spark.createDataFrame([('{"a": 1}',), ("{broken",), ('{"a": null}',), (None,)], "value string")
    write = streams.quarantine_sink(str(tmp_path / "good"), str(tmp_path / "bad"), schemas.T.StructType.fromDDL("a int"))
    for _ in range(2):  # a replay of a batch overwrites itself
        write(lines, 7)
    assert sorted((r.a for r in spark.read.parquet(str(tmp_path / "good")).collect()), key=str) == [1, None]
    assert {r.payload for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"{broken", None}


def test_append_only_new_and_run_log(spark, tmp_path):
    d = lambda *r: spark.createDataFrame([*r], "date string, v int")
    path = str(tmp_path / "t")
    sinks.append_only_new(spark, d(("1", 1), ("2", 2)), path, ["date"])
    sinks.append_only_new(spark, d(("2", 9), ("3", 3)), path, ["date"])
    assert sorted(map(tuple, sinks.table_or_none(spark, path).collect())) == [("1", 1), ("2", 2), ("3", 3)]
    r = sinks.run_log_row(spark, "market", "b", 10.0, 4.0).unionByName(sinks.run_log_row(spark, "market", "b", 10.0, 0.0)).collect()
    assert [x.ratio for x in r] == [2.5, 0.0] and all(x.ts for x in r)


def test_first_of_three_sources(spark):
    t = lambda *r: spark.createDataFrame([*r], "year int, rate double")
    none, default = t(), t((2020, 0.3))
    year = lambda d: [r.year for r in d.collect()]
    assert year(readers.first_nonempty([t((1, 0.1)), t((2, 0.1)), t((3, 0.1))], default)) == [1]
    assert year(readers.first_nonempty([none, t((2, 0.1)), t((3, 0.1))], default)) == [2]
    assert year(readers.first_nonempty([none, none, t((3, 0.1))], default)) == [3]
    assert year(readers.first_nonempty([none, none, none], default)) == [2020]


def test_xml_and_labels(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><item><title>a</title><n>1</n></item><item><title>b</title></item></rss>")
    got = readers.read_xml(spark, str(tmp_path / "f.xml"), "item", schemas.T.StructType.fromDDL("title string, n int"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", None)]
    d = spark.createDataFrame([("Ürün: Nar\n Fiyat : 12,5 \nNot:",)], "t string")
    f = readers.labelled_fields(F.col("t"), ["Ürün", "Fiyat", "Not"])
    assert tuple(d.select(*[c.alias(k) for k, c in f.items()]).first()) == ("Nar", "12,5", None)


def test_flags_and_messages_are_columns(spark):
    d = spark.createDataFrame([(0.0, 20.0), (0.1, None)], "t2m_min double, prectotcorr double")
    assert [(r.frost, r.heavy_rain) for r in weather.flags(d).collect()] == [(True, True), (False, False)]
    assert json.loads(d.select(F.to_json(F.struct("*")).alias("j")).first().j) == {"t2m_min": 0.0, "prectotcorr": 20.0}


# ---- topics


def test_topic_contract():
    assert set(streams.CONTRACT) == set(streams.TOPICS)
    o = streams.topic_options("raw_gdelt", trigger_s=900)
    assert o["minPartitions"] == "6" and int(o["maxOffsetsPerTrigger"]) == 100_000 and streams.topic_options("raw_tcmb")["maxOffsetsPerTrigger"] == "300"


def test_retention(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 5),)], "at timestamp")
    now = F.lit(dt.datetime(2024, 1, 9)).cast("timestamp")
    assert [r.x for r in d.select(streams.expired("raw_weather", "at", now).alias("x")).collect()] == [True, False]
    assert [r.x for r in d.select(streams.expired("raw_hal_prices", "at", now).alias("x")).collect()] == [False, False]


def test_bronze_and_message_streams(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: streams.read_events(spark, str(tmp_path / "in"), src.schema, max_files=1)
    for _ in range(2):  # a second run finds nothing new
        streams.bronze_sink(read(), str(tmp_path / "out"), str(tmp_path / "cp"), "ts").trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == src.count() and out.select("day").distinct().count() == src.select(F.to_date("ts")).distinct().count()
    q = sinks.keyed_messages(read(), "concat(event_type, ':', user_id)").writeStream.format("parquet").option("path", str(tmp_path / "msg")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "msg")).filter("key like 'click:%'").first()
    assert r.key == f"click:{json.loads(r.value)['user_id']}" and spark.read.parquet(str(tmp_path / "msg")).count() == src.count()
