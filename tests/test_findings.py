"""What a reviewer found at larger tables or odd inputs, each as a small case."""

import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from pricelattice.operators import cells, joins
from pricelattice.plans import catalog, extended
from pricelattice.sources import datasets

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_sketch_for_every_distinct_value(spark):
    """Beside count(distinct) Spark would keep each sketch by (flag, part)."""
    by_part = [line for line in plan(catalog.approx_distinct(spark, SF)).splitlines() if re.search(r"keys=\[[^]]*l_partkey", line)]
    assert by_part and not [line for line in by_part if "approx" in line or "percentile" in line]


def km(a, b):
    p, q, s, t = *a, *b
    h = math.sin(math.radians(s - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(s)) * math.sin(math.radians(t - q) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def test_places_are_those_of_the_sql(spark):
    d = spark.range(4000).toDF("k")
    got = {r.k: (r.lat, r.lon) for r in extended._on_sphere(d, "k").collect()}
    assert {k: (a, b) for k, a, b in duckdb.sql(extended._sphere_sql("range(4000) t(k)", "k")).fetchall()} == got


def test_equally_far_sites(spark):
    """Sites as far east as west: what rounding leaves of the difference decides as it does in the SQL engine."""
    points = [(i, (7 * i % 1200) / 10 - 60, (i * 37 % 3000) / 10 - 150) for i in range(60)]
    sites = [(2 * i + k, lat, lon + (1 - 2 * k) * (1 + i % 9) / 10) for i, lat, lon in points for k in (0, 1)]
    p, s = spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(sites, "s int, lat double, lon double")
    want = {i: min((km((a, b), (c, d)), k) for k, c, d in sites) for i, a, b in points}
    assert {r.p: (r.distance_km, r.s) for r in joins.nearest_site(p, s, 300.0, "p", "s").collect()} == want
    got = {r.p: (r.s, r.radius_km) for r in joins.nearest_with_fallback(p, s, "p", "s", (20.0, 40.0, 300.0)).collect()}
    assert got == {i: (k, 20.0 if d <= 20 else 40.0 if d <= 40 else 300.0) for i, (d, k) in want.items()}


def test_many_rows_at_one_place(spark):
    """30000 points beside 30000 sites are 900 million pairs, and two places."""
    p = spark.range(30_000).selectExpr("id as p", "41D as lat", "29D as lon")
    s = spark.range(30_000).selectExpr("id as s", "41.1D as lat", "29D as lon")
    assert joins.nearest_site(p, s, 50.0, "p", "s").groupBy("s").count().collect() == [(0, 30_000)]
    assert cells.counts_within(p, s, 50.0, "s", "n").groupBy("n").count().collect() == [(30_000, 30_000)]


def test_counts_within_everywhere(spark):
    rng = random.Random(5)
    around = [(88.0, 10.0), (80.0, -179.9), (0.0, 179.9), (-90.0, 0.0), (41.0, 29.0), (-60.0, 180.0)]
    place = lambda: (max(-90.0, min(90.0, (c := rng.choice(around))[0] + rng.uniform(-6, 6))), (c[1] + rng.uniform(-9, 9) + 540) % 360 - 180)
    points, sites = [place() for _ in range(400)], [place() for _ in range(40)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(0, *points[0]), (900, None, 1.0), (901, 1.0, float("nan"))], "p int, lat double, lon double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)] + [(900, None, None)], "s int, lat double, lon double")
    for radius in (60.0, 700.0, 4000.0):
        want = {k: n for k, y in enumerate(sites) if (n := sum(km(x, y) <= radius for x in [*points, points[0]]))}
        assert {r.s: r.n for r in cells.counts_within(p, s, radius, "s", "n").collect()} == want


def test_records_are_read_once(spark):
    """No filter reads the record again for each field that it asks."""
    text = ['{"date":"2024-01-01T00:00:00","time":"00:00","plantId":1,"toplam":2.5}', '{"date":"2024-01-01T00:00:00","toplam":"x"}', '{"date":null,"toplam":1}', '{"date":"d","more":1}', "[1]", "{x", "{}", None]
    raw = spark.createDataFrame([("kgup", t) for t in text] + [("other", text[0])], "call string, record string")
    rows, bad = datasets.typed(raw, "kgup")
    assert [r.toplam for r in rows["kgup"].collect()] == [2.5]
    drifts = sorted(r.drift for r in bad.collect())
    assert drifts == sorted(["type: toplam", "no time", "unknown: more", "no object", "no object", "no time", "no object", "unknown call"])
    df = rows["kgup"].select(F.col("plantId"))
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in optimized.splitlines() if "Filter" in line and "from_json" in line]
