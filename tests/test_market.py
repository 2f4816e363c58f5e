"""Names, places and series: cases worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from pricelattice.operators import places, products, series

def test_product_names(spark):
    aliases = [("domates", "Domates", "Sebze"), ("erik can", "Erik", "Meyve"), ("erik", "Erik (diğer)", "Meyve")]
    raw = ["  DOMATES \t salkım ", "Erik", "can", "mor (havuç) 2.SINIF", "", None]
    name, category = products.standard_product(F.col("raw"), aliases)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", name.alias("n"), category.alias("c")).orderBy("i")
    got = [(r.n, r.c) for r in df.collect()]
    # Equal before contained; the first that holds the key; no alias; a blank name is part of every alias; null.
    assert got == [("Domates", "Sebze"), ("Erik (diğer)", "Meyve"), ("Erik", "Meyve"), ("Mor (Havuç) 2.Sinif", "Diğer"), ("Domates", "Sebze"), (None, "Diğer")]


def test_boxes(spark):
    asked = spark.createDataFrame([("c", "Kadıköy"), ("c", "none")], "city string, district string")
    rows = [
        (1, "place", "city", "kadıköy", ["1", "2", "3", "4"]), (2, "boundary", "administrative", "other", ["5", "6", "7", "8"]), (3, "boundary", "administrative", "kadıköy, c", ["1", "1.01", "3", "4"]),
        (4, "boundary", "administrative", "Kadıköy, c", ["9", "10", "11", "12"]), (5, "boundary", "administrative", "kadıköy", ["x", "10", "11", "12"]), (6, "boundary", "administrative", "kadıköy", None),
    ]
    results = spark.createDataFrame([("c", "Kadıköy", *r) for r in rows], "city string, district string, rank int, class string, type string, display_name string, boundingbox array<string>")
    got = {r.district: r.bbox for r in places.choose_bbox(asked, results).collect()}
    assert got == {"Kadıköy": [9.0, 10.0, 11.0, 12.0], "none": None}


def test_windows_of_requests(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2021, 8, 23)), (2, dt.date(2020, 1, 2), dt.date(2020, 1, 1)), (9, dt.date(2020, 1, 1), dt.date(2020, 1, 1))], "f int, a date, b date")
    got = [(r.f, r.window_start, r.window_end) for r in series.request_windows(df, "a", "b", F.col("f")).orderBy("f", "window_start").collect()]
    assert got == [(1, dt.date(2020, 1, 1), dt.date(2021, 8, 22)), (1, dt.date(2021, 8, 23), dt.date(2021, 8, 23)), (9, dt.date(2020, 1, 1), dt.date(2020, 1, 1))]
