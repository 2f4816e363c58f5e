"""Generated messages, streams run as streams, and report files."""

import json

from pyspark.sql import functions as F

from pricelattice.sources import registry, sinks
from pricelattice.streaming import demo, streams

SF = "/root/testdata/sf0.001"


def test_messages(spark):
    ticks = spark.range(50).select(F.col("id").alias("n"), F.lit("2024-05-06 07:08:09").cast("timestamp").alias("at"))
    assert set(demo.FIELDS) == set(streams.TOPICS) == set(demo.PERIOD_MS)
    got = {t: [(r.key, json.loads(r.value)) for r in demo.messages(ticks, t).collect()] for t in streams.TOPICS}
    for t, rows in got.items():
        assert len(rows) == 50 and all(list(v) == list(demo.FIELDS[t]) for _, v in rows)
    assert all(k == v["productId"] and 0 <= int(k) < 10000 and 0 <= v["price"] < 50 for k, v in got["raw_market_prices"])
    assert {k for k, _ in got["raw_epias"]} == {"price_and_cost:07:00"} and {k for k, _ in got["raw_weather"]} == {"36.8969,30.7133"}
    assert {k for k, _ in got["raw_akaryakit"]} == {"İstanbul:Benzin"} and all(-10 <= v["tone"] < 10 for _, v in got["raw_gdelt"])
    assert got["raw_tcmb"] == [(r.key, json.loads(r.value)) for r in demo.messages(ticks, "raw_tcmb").collect()]
    live = demo.stream(spark, "raw_epias")
    assert live.isStreaming and live.columns == ["key", "value"]


def _ran(stream, name, mode, tmp_path, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.unionByName(src).repartition(2).write.parquet(str(tmp_path / "twice"))
    src.repartition(2).write.parquet(str(tmp_path / "once"))
    read = lambda p: streams.read_events(spark, str(tmp_path / p), src.schema)
    rows = lambda d: sorted(map(repr, d.collect()))
    session = lambda d: streams.sessions(d, "ts", "6 hours", ["user_id"])
    slide = lambda d: streams.sliding(d, "ts", "2 hours", "1 hour", ["event_type"], "value").withColumn("mean", F.round("mean", 6))
    assert rows(_ran(session(read("once")), "t_sessions", "complete", tmp_path, spark)) == rows(session(src))
    assert rows(_ran(slide(read("once")), "t_sliding", "complete", tmp_path, spark)) == rows(slide(src))
    assert rows(_ran(streams.dedup(read("twice"), "ts", ["event_id"]), "t_dedup", "append", tmp_path, spark).select("event_id")) == rows(src.select("event_id"))


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("b", "çilek", 2), ("a", "nar", None), ("c", 'x"y,', 3)], "kategori string, urun string, n int")
    sinks.write_csv_report(df, str(tmp_path / "csv"), ["kategori"])
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfkategori,urun,n\n") and text.decode("utf-8-sig").splitlines()[1].startswith("a,nar")
    sinks.write_json_lines(df, str(tmp_path / "lines"))
    lines = [json.loads(x) for f in (tmp_path / "lines").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["kategori"])[0] == {"kategori": "a", "urun": "nar", "n": None} and len(lines) == 3
    for name, d, n in (("array", df, 3), ("none", df.limit(0), 0)):
        sinks.write_json_array(d, str(tmp_path / name))
        assert len(json.loads(next((tmp_path / name).glob("part-*")).read_text())) == n


def test_energy_sources(spark, tmp_path):
    assert registry.REGISTRY["epias/wind_forecast"].max_range_months == 1 and registry.REGISTRY["epias/dam_volume"].max_range_months == 12
    (tmp_path / "dam.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00+03:00", "damName": "x", "currentLevel": 1.5}\n')
    assert registry.load(spark, "epias/dam_daily_level", str(tmp_path / "dam.jsonl")).select("damName", "currentLevel").collect() == [("x", 1.5)]
