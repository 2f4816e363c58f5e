"""Rows that tie on key and priority end alike, however the table is dealt."""

from pyspark.sql import functions as F

from pricelattice.operators import dedup, energy, reshape


def test_upsert_by_arrival_then_by_values(spark):
    old = spark.createDataFrame([(1, 1, "old"), (2, 1, "old")], "k int, seq int, v string")
    new = spark.createDataFrame([(1, 2, "z"), (1, 3, "a"), (1, 3, "b"), (3, None, "n"), (3, 0, "m")], "k int, seq int, v string")
    for n in (1, 7):
        got = dedup.upsert(old.repartition(n), new.repartition(n), ["k"], ["seq"])
        assert sorted(map(tuple, got.collect())) == [(1, 3, "b"), (2, 1, "old"), (3, 0, "m")]


def test_upsert_with_a_map(spark):
    old = spark.createDataFrame([(1, {"a": 1})], "k int, m map<string,int>")
    new = spark.createDataFrame([(1, {"a": 2}), (2, None)], "k int, m map<string,int>")
    assert sorted(map(tuple, dedup.upsert(old, new, ["k"]).collect()), key=str) == [(1, {"a": 2}), (2, None)]


def test_by_priority_takes_the_least_row(spark):
    a = spark.createDataFrame([(1, 9), (1, 4)], "k int, v int")
    b = spark.createDataFrame([(1, 1), (2, 8), (2, 6), (None, 5)], "k int, v int")
    got = dedup.by_priority([("a", a.repartition(5)), ("b", b.repartition(5))], ["k"])
    assert sorted(map(tuple, got.select("k", "v", "source").collect()), key=str) == [(1, 4, "a"), (2, 6, "b"), (None, 5, "b")]


def test_intraday_keeps_one_row_of_a_contract(spark):
    p = spark.createDataFrame([("d", "PH1", 3.0), ("d", "PH1", 2.0), ("d", "PH2", None)], "date string, kontratAdi string, price double")
    v = spark.createDataFrame([("d", "PH1", 10), ("d", "PH3", 7)], "date string, kontratAdi string, volume int")
    got = sorted(map(tuple, energy.intraday(p.repartition(3), v).select("date", "kontratAdi", "price", "volume").collect()))
    assert got == [("d", "PH1", 2.0, 10), ("d", "PH2", None, None), ("d", "PH3", None, 7)]


def test_normalize_goes_by_order_first(spark):
    d = spark.createDataFrame([("2026-01-01T00:00:00+03:00", 1, 9.0), ("2026-01-01T00:00:00+03:00", 2, 1.0)], "date string, seq int, price double")
    assert [r.price for r in energy.normalize(d, "x", "y", "z", order=["seq"]).collect()] == [1.0]
    assert [r.price for r in energy.normalize(d.withColumn("m", F.create_map(F.lit("a"), F.col("seq"))), "x", "y", "z", order=["seq"]).collect()] == [1.0]


def test_densify_beyond_the_bound(spark):
    facts = spark.createDataFrame([(1, "a", 5)], "x int, y string, n int")
    xs, ys = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([("a",), ("b",)], "y string")
    for bound in (100, 1):
        got = reshape.densify(facts, [xs, ys], ["x", "y"], {"n": 0}, bound)
        assert sorted(map(tuple, got.select("x", "y", "n").collect())) == [(1, "a", 5), (1, "b", 0), (2, "a", 0), (2, "b", 0)]
