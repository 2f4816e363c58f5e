"""Similarity joins, spherical cells, clamped chains, state versions, sketches, cards, catalogues and energy records, against plain Python."""

import datetime as dt
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricelattice.functions import numeric as N
from pricelattice.functions import provinces
from pricelattice.operators import catalogue, cells, html, joins, ranking, similarity, sketches, wholesale, windows
from pricelattice.sources import datasets, sinks
from pricelattice.sources import state as st

SF = "/root/testdata/sf0.001"


# ---- names


def cosine(names: list[str], stop=()) -> dict:
    bags = [tuple(sorted(w for w in re.split(r"[^\w]+", n.lower()) if w and w not in stop)) for n in names]
    df, n = Counter(), len(bags)
    for b in bags:
        df.update(set(b))
    vec = {}
    for b in set(bags):
        w = {t: k * (math.log(n / df[t]) + 1) for t, k in Counter(b).items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        vec[b] = {t: x / size for t, x in w.items()} if size else {}
    return {(" ".join(min(a, b)), " ".join(max(a, b))): sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) for a, b in itertools.combinations(sorted(vec, key=" ".join), 2) if a and b}


@pytest.fixture(scope="module")
def names():
    rng = random.Random(8)
    rare = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(500):
        k = rng.randint(0, 5)
        out.append(" ".join(rng.choice(["red", "red", "fresh", "big"]) if rng.random() < 0.6 else rng.choice(rare) for _ in range(k)))
    return out + ["red", "red red", "Fresh-Red", "big w1 w2", "big w1 w2"]


@pytest.mark.parametrize("hot", [1, 5, 200])
@pytest.mark.parametrize("threshold", [0.45, 0.8])
def test_tfidf_pairs_lose_nothing(spark, names, hot, threshold):
    want = {p: s for p, s in cosine(names).items() if s >= threshold - 1e-9}
    d = spark.createDataFrame([(x,) for x in [*names, None]], "title string")
    # A null title counts as a row; so does it in the check: N only shifts weights, which the comparison uses too.
    got = {(r.bag_a, r.bag_b): r.similarity for r in similarity.tfidf_names(d.filter("title is not null"), "title", threshold, hot=hot).collect()}
    order = lambda p: tuple(sorted(p))
    assert {order(p) for p in got} == {order(p) for p in want} and len(want) > 100
    assert got == pytest.approx({p if p in got else p[::-1]: s for p, s in want.items()}, abs=1e-9)


def test_common_words_are_not_paired_all_with_all(spark):
    """One word in every name: candidates stay near the number of results."""
    rows = [(f"common x{i} y{i % 400}",) for i in range(2000)] + [(f"common x{i} y{i % 400} z",) for i in range(0, 2000, 10)]
    vec = similarity.vectors(similarity.bags(spark.createDataFrame(rows, "t string"), None, "t"))
    keys = similarity.block_keys(similarity.postings(vec), 0.7)
    sizes = keys.groupBy("word", "second", "low", "high").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert sizes < 200_000  # all pairs would be 4.8 million


def test_tfidf_join_of_two_tables(spark):
    l = spark.createDataFrame([(1, "Domates Salkım"), (2, "İthal Muz ve"), (3, None), (4, "ve"), (5, "Salkım domates")], "a int, t string")
    r = spark.createDataFrame([(10, "salkım-domates"), (11, "muz ithal"), (12, ""), (13, "elma")], "b int, t string")
    got = {(x.a, x.b) for x in similarity.tfidf_join(l, r, "a", "b", "t", 0.9, similarity.STOP_WORDS).collect()}
    assert got == {(1, 10), (5, 10), (2, 11)}


# ---- sphere


def haversine(a, b):
    p, q, s, t = map(math.radians, (*a, *b))
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin((t - q) / 2) ** 2)))


@pytest.mark.parametrize("radius", [30.0, 400.0, 3000.0])
def test_nearest_site_everywhere(spark, radius):
    rng = random.Random(3)
    around = [(80.0, 10.0), (80.0, -179.9), (0.0, 179.9), (-89.9, 0.0), (90.0, 0.0), (45.0, -180.0), (41.0, 29.0), (-60.0, 179.95)]
    place = lambda: (max(-90.0, min(90.0, (c := rng.choice(around))[0] + rng.uniform(-4, 4))), (c[1] + rng.uniform(-6, 6) + 540) % 360 - 180)
    points, sites = [place() for _ in range(300)], [place() for _ in range(120)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(900, None, 1.0), (901, 91.0, 1.0), (902, 1.0, float("nan"))], "p int, lat double, lon double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)] + [(900, None, None)], "s int, lat double, lon double")
    got = {r.p: (r.s, round(r.distance_km, 6)) for r in joins.nearest_site(p, s, radius, "p", "s").collect()}
    want = {}
    for i, x in enumerate(points):
        d, k = min((haversine(x, y), k) for k, y in enumerate(sites))
        if d <= radius:
            want[i] = (k, round(d, 6))
    assert got == want and want


def test_cells_lie_in_their_parents(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(rng.uniform(-90, 90), rng.uniform(-400, 400)) for _ in range(500)] + [(90.0, 0.0), (-90.0, 180.0), (0.0, -180.0)], "lat double, lon double")
    for level in (1, 4, 9, 17, 24):
        up = d.filter(~(cells.parent(cells.cell(F.col("lat"), F.col("lon"), level), level) == cells.cell(F.col("lat"), F.col("lon"), level - 1)))
        assert up.count() == 0


# ---- weather


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_radiation_and_et0_of_worked_examples(spark):
    """The examples of the FAO's paper 56: numbers 8 (3 September at 20 degrees south), 11 (Rio de Janeiro, May) and 18 (Brussels, 6 July)."""
    f = lambda x: F.lit(float(x))
    assert one(spark, N.extraterrestrial_mj(f(-20), f(246))) == pytest.approx(32.2, abs=0.05)
    assert one(spark, N.net_longwave_mj(f(25.1), f(19.1), f(2.1), f(14.5), f(18.8))) == pytest.approx(3.5, abs=0.05)
    net = N.net_radiation_mj(f(21.5), f(12.3), f(1.409), f(22.07), f(50.8), f(187), 100.0)
    assert one(spark, net) == pytest.approx(13.28, abs=0.03)
    assert one(spark, N.penman_monteith(f(21.5), f(12.3), f(16.9), f(1.409), f(2.078), net, f(100.1))) == pytest.approx(3.88, abs=0.03)
    assert one(spark, N.extraterrestrial_mj(f(85), f(355))) == 0.0 and one(spark, N.extraterrestrial_mj(f(85), f(172))) > 40
    assert one(spark, N.fao56_et0(f(21), f(12), f(16), f(60), f(3), f(6), f(100), F.lit(None).cast("double"), f(187))) is None


def test_one_chain_over_many_tasks(spark):
    """One key with 300000 rows: states as in a loop, and no task of the row stages has a tenth of them."""
    n = 300_000
    d = spark.range(n).select(F.lit(1).alias("k"), "id", ((F.col("id") * 7919) % 101 - 50.0).alias("d"))
    out = windows.clamped_balance(d, ["k"], "id", F.col("d"), bucket_s=5000)
    x, want = 75.0, {}
    for i in range(n):
        x = min(150.0, max(0.0, x + i * 7919 % 101 - 50.0))
        if i % 9973 == 0 or i == n - 1:
            want[i] = x
    got = {r.id: r.state for r in out.filter(F.col("id").isin(list(want))).collect()}
    assert got == want and out.count() == n
    assert max(r["count"] for r in d.groupBy(F.floor(F.col("id") / 5000)).count().collect()) <= n / 10


def test_chain_with_ties_nulls_and_null_keys(spark):
    rows = [(None, 1, 10.0), (None, 2, None), (None, 2, -200.0), (None, None, 5.0), (7, 3, float("nan")), (7, 4, -10.0)]
    d = spark.createDataFrame(rows, "k int, at int, d double")
    got = sorted(((r.k, r["at"], r.state) for r in windows.clamped_balance(d, ["k"], "at", F.col("d"), bucket_s=1, lot=2).collect()), key=str)
    assert got == sorted([(None, None, 80.0), (None, 1, 90.0), (None, 2, 0.0), (None, 2, 0.0), (7, 3, 150.0), (7, 4, 140.0)], key=str)


# ---- state


def test_state_after_a_crash(spark, tmp_path):
    src = spark.createDataFrame([("a", dt.datetime(2024, 1, d, h), d * 100 + h) for d in (1, 2, 3) for h in (0, 12)], "k string, at timestamp, v int")
    src = sinks.with_partitions(src, F.to_date("at"), ["year", "month", "day"])
    parts, target, path = ["year", "month", "day"], str(tmp_path / "t"), str(tmp_path / "s")
    go = lambda rows, **o: st.run(spark, rows, target, path, "k", "at", ["k", "at"], parts, dt.datetime(2024, 1, 1), **o)
    assert go(src.filter("day < '03'")) == 1

    def crash():
        raise RuntimeError("lost")

    newer = src.withColumn("v", F.when(F.col("day") == "02", -1).otherwise(F.col("v")))
    with pytest.raises(RuntimeError):
        go(newer, before_commit=crash)
    table = st.StateTable(spark, path)
    assert table.version() == 1 and table.read().first().last_observation_at == dt.datetime(2024, 1, 2, 12)  # the state does not run ahead of the data
    assert go(newer) == 2 and table.read().first().last_observation_at == dt.datetime(2024, 1, 3, 12)
    rows = sorted((r["at"].day, r["at"].hour, r.v) for r in sinks.table_or_none(spark, target).collect())
    assert rows == [(1, 0, 100), (1, 12, 112), (2, 0, -1), (2, 12, -1), (3, 0, 300), (3, 12, 312)]
    folder = table.prepare(table.read())
    with pytest.raises(st.Conflict):
        table.commit(folder, 1)  # another run was first
    assert go(newer.limit(0)) == 3 and table.read().count() == 1  # a run without rows keeps what is known


def test_late_rows_are_dropped_where_so_wanted(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d), d) for d in (1, 2)]
    make = lambda r: sinks.with_partitions(spark.createDataFrame(r, "k string, at timestamp, v int"), F.to_date("at"), ["year", "month", "day"])
    go = lambda r: st.run(spark, make(r), str(tmp_path / "t"), str(tmp_path / "s"), "k", "at", ["k", "at"], ["year", "month", "day"], dt.datetime(2024, 1, 1), late="drop")
    assert go(rows) == 1
    assert go([*rows, ("a", dt.datetime(2024, 1, 2, 5), 99), ("a", dt.datetime(2024, 1, 3), 3)]) == 2
    assert sorted(r.v for r in sinks.table_or_none(spark, str(tmp_path / "t")).collect()) == [1, 2, 3]


# ---- sketches


def test_sketches_merge_alike_however_they_are_cut(spark, tmp_path):
    l = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_returnflag", "l_partkey", "l_extendedprice", F.month("l_shipdate").alias("m"), (F.col("l_orderkey") % 5).alias("c"))
    sketches.sketched(l, ["l_returnflag", "m"], "l_partkey", "l_extendedprice").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    a = sketches.estimates(sketches.merged(stored, ["l_returnflag"]), ["l_returnflag"])
    b = sketches.estimates(sketches.merged(sketches.sketched(l, ["l_returnflag", "c"], "l_partkey", "l_extendedprice"), ["l_returnflag"]), ["l_returnflag"])
    x, y = ({r.l_returnflag: (r.n, r.distinct_estimate) for r in d.collect()} for d in (a, b))
    assert x == y
    some = sketches.estimates(sketches.merged(stored.filter("m <= 3"), []), []).first()
    assert some.n == l.filter("m <= 3").count()


# ---- cards


def test_cards_in_cards(spark):
    page = "</div><!-- <div>no</div> --><DIV class='x'>a<div id=1>b<div>c</div></div>d</div><divider>e</divider><div>open <script>'</div>'</script>end"
    d = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None), (4, "<div></div>")], "id int, html string")
    got = [(r.id, r.card_no, r.depth, r.inner) for r in html.nested_cards(d, "id", "html", "div").orderBy("id", "card_no").collect()]
    assert got == [(1, 0, 1, "a<div id=1>b<div>c</div></div>d"), (1, 1, 2, "b<div>c</div>"), (1, 2, 3, "c"), (1, 3, 1, "open end"), (4, 0, 1, "")]
    assert [r.inner for r in html.nested_cards(d, "id", "html", "div", marked="class='x'").collect()] == ["a<div id=1>b<div>c</div></div>d"]


def test_price_cards_and_repeated_pages(spark):
    card = lambda n, a, b: f"<div class='c'><h3>{n}</h3><span>En Düşük</span><b>{a} TL</b><span>En Yüksek</span><b>{b}</b><i>05.04.2026 Pazar</i></div>"
    pages = [("x", 1, card("Nar", "20,5", "10") + card("Muz", "0", "4")), ("x", 2, card("Elma &amp; Armut", "3", "4")), ("x", 3, card("Elma &amp; Armut", "3", "4")), ("x", 4, card("Kivi", "1", "2")), ("y", 1, card("Kivi", "7.25", "7.5")), ("y", 3, card("Limon", "1", "2"))]
    d = spark.createDataFrame(pages, "site string, page int, html string").withColumn("id", F.concat_ws("/", "site", "page"))
    cards = html.nested_cards(d, "id", "html", "div").join(d.select("id", "site", "page"), "id").withColumn("text", F.array_join(html.lines(F.col("inner")), " "))
    shown = html.until_repeat(cards, "site", "page", "text")
    got = sorted((r.site, r.page, r.product, r.low, r.high, r.day_text) for r in html.price_cards(shown.select("site", "page", "inner")).collect())
    assert got == [("x", 1, "Nar", 10.0, 20.5, "05.04.2026"), ("x", 2, "Elma & Armut", 3.0, 4.0, "05.04.2026"), ("y", 1, "Kivi", 7.25, 7.5, "05.04.2026")]


def test_walk_ends_in_a_circle(spark):
    n = spark.createDataFrame([(None, "a", "A", "category"), ("a", "b", "B", "group"), ("b", "c", "C", "series"), ("c", "a", "A", "category"), ("zz", "y", "Y", "series")], "parent string, code string, name string, kind string")
    assert [r.path for r in catalogue.walk(n, depth=4).orderBy("level").collect()] == ["A", "A / B", "A / B / C", "A / B / C / A"]
    assert {r.path for r in catalogue.series_of(n, "b").collect()} >= {"B / C"} and catalogue.walk(n, "nothing").count() == 0


# ---- prices and names


def test_wholesale_curves_and_places(spark):
    assert [wholesale.curve(a)[m - 1] for _, a in wholesale.ANCHORS for m in a] == [v for _, a in wholesale.ANCHORS for v in a.values()]
    assert wholesale.curve({7: 0.65, 1: 1.3})[3] == pytest.approx(0.975)
    base = spark.createDataFrame([("ANTALYA", "Domates", "Sebze", 54.0, 121.0), ("Nowhere", "Soğan", "Sebze", 0.001, None)], "sehir string, urun string, kategori string, en_dusuk double, en_yuksek double")
    days = F.array(F.lit(dt.date(2026, 7, 1)), F.lit(dt.date(2016, 1, 1)), F.lit(dt.date(2010, 1, 1)))
    got = {(r.sehir, r.tarih.year): (r.en_dusuk, r.en_yuksek) for r in wholesale.history(base, days, noise=False).collect()}
    assert got["ANTALYA", 2026] == (round(54 * 0.8 * 0.65, 2), round(121 * 0.8 * 0.65, 2)) and got["ANTALYA", 2016] == (round(54 / 26.339 * 0.8 * 1.3, 2), round(121 / 26.339 * 0.8 * 1.3, 2))
    assert got["ANTALYA", 2010] == (None, None) and got["Nowhere", 2026] == (0.01, None)
    noisy = wholesale.history(base.limit(1), F.expr("sequence(date'2026-01-01', date'2026-12-31', interval 1 day)"))
    flat = wholesale.history(base.limit(1), F.expr("sequence(date'2026-01-01', date'2026-12-31', interval 1 day)"), noise=False).select("tarih", F.col("en_dusuk").alias("f"))
    r = noisy.join(flat, "tarih").select((F.col("en_dusuk") / F.col("f")).alias("q")).agg(F.min("q"), F.max("q"), F.countDistinct("q")).first()
    assert 0.9598 <= r[0] < 0.97 and 1.03 < r[1] <= 1.0402 and r[2] > 300


def test_every_province(spark):
    assert len(set(provinces.PROVINCES)) == 81 and set(provinces.SPELLED) <= set(provinces.PROVINCES)
    d = spark.createDataFrame([(p,) for p in provinces.PROVINCES] + [("istanbul ",), ("Paris",), (None,)], "n string").withColumn("s", provinces.service_name(F.col("n")))
    got = {r.n: (r.s, r.b) for r in d.withColumn("b", provinces.province_of(F.col("s"))).collect()}
    assert all(got[p][1] == p for p in provinces.PROVINCES) and got["istanbul "][0] == "ISTANBUL" and got["MERSİN"][0] == "İÇEL" and got["Paris"] == got[None] == (None, None)


# ---- energy


def test_every_dataset_is_typed():
    assert len(datasets.DATASETS) == 26
    for name, spec in datasets.DATASETS.items():
        fields = {n for ddl in spec.calls.values() for n in datasets._names(ddl)}
        assert set(spec.keys) <= fields and fields & set(datasets.TIMES), name


def test_request_windows():
    w = lambda name, a, b: datasets.windows(datasets.DATASETS[name], dt.date.fromisoformat(a), dt.date.fromisoformat(b))
    assert w("wind_forecast", "2024-01-31", "2024-03-05") == [("2024-01-31", "2024-02-28"), ("2024-02-29", "2024-03-05")]
    assert w("kgup", "2024-11-15", "2025-03-01") == [("2024-11-15", "2025-02-14"), ("2025-02-15", "2025-03-01")]
    assert w("planned_outages", "2024-01-20", "2024-03-02") == [("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]
    assert w("dam_active_volume", "2024-01-01", "2024-01-02") == [("", "")] and w("kgup", "2024-01-02", "2024-01-01") == []


def test_energy_source(spark, tmp_path):
    def landed(name, a, b):
        raw = datasets.records(spark, name, a, b, "tests.fake_transport:energy")
        raw.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    raw = landed("wind_forecast", "2024-01-01", "2024-02-10")
    assert {(r.lo, r.hi) for r in raw.collect()} == {("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-10")}
    rows, bad = datasets.dataset(raw, "wind_forecast", "now")
    assert sorted((r.timestamp, r.generation) for r in rows.collect()) == [("2024-01-31T23:00:00+03:00", 2.0), ("2024-02-10T23:00:00+03:00", 2.0)]
    assert {r.drift for r in bad.collect()} == {"type: forecast"} and bad.count() == 2
    rows, bad = datasets.dataset(landed("primary_frequency_capacity", "2024-01-01", "2024-01-02"), "primary_frequency_capacity", "now")
    assert sorted((r.timestamp, r.amount, r.price) for r in rows.collect()) == [("2024-01-01T00:00:00+03:00", 0.5, 0.5), ("2024-01-01T01:00:00+03:00", 1.5, 1.5), ("2024-01-01T02:00:00+03:00", 2.5, None)]
    rows, _ = datasets.dataset(landed("intraday_market", "2024-01-01", "2024-01-02"), "intraday_market", "now")
    assert [(r.timestamp, r.kontratAdi, r.clearingQuantityAsk, r.volume) for r in rows.collect()] == [("2024-01-02T03:00:00+03:00", "PH24010203", 1.0, 7.5)]
    rows, _ = datasets.dataset(landed("dam_active_volume", "2024-01-01", "2024-01-02"), "dam_active_volume", "now")
    assert sorted((r.damName, r.activeVolume) for r in rows.collect()) == [("x", 1.5), ("y", 2.0)]  # dams of one time stay apart
    rows, bad = datasets.dataset(landed("planned_outages", "2024-01-20", "2024-02-02"), "planned_outages", "now")
    assert sorted((r.timestamp, r.id) for r in rows.collect()) == [("2024-01-01T05:00:00+03:00", 1), ("2024-02-01T05:00:00+03:00", 1)] and {r.drift for r in bad.collect()} == {"unknown: surprise"}


# ---- ranks


def test_ranks_equal_window_functions(spark):
    from pyspark.sql import Window

    rng = random.Random(6)
    values = [None, float("nan"), 0.0, -1.5, 1e300, 7.0]
    rows = [(rng.choice(["a", "b", None]), rng.choice(values) if rng.random() < 0.4 else round(rng.uniform(-50, 900), 1), i % 40) for i in range(900)] + [("one", 1.0, 1)]
    d = spark.createDataFrame(rows, "k string, v double, t int")
    w = Window.partitionBy("k").orderBy("v", "t")
    want = d.select("k", "v", "t", F.rank().over(w).alias("r"), F.ntile(7).over(w).alias("q"), F.percent_rank().over(w).alias("p"), F.dense_rank().over(Window.partitionBy("k").orderBy("v")).alias("d"))
    r = ranking.ranked(d, ["k"], "v", ["t"])
    got = r.select("k", "v", "t", F.col("_rank").cast("int").alias("r"), ranking.tile(7, F.col("_row"), F.col("_total")).alias("q"), ranking.percent(F.col("_rank"), F.col("_total")).alias("p"), F.col("_dense").cast("int").alias("d"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    sizes = d.filter("k = 'a'").groupBy(ranking.value_range(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert sizes < 0.2 * d.filter("k = 'a'").count()


# ---- joins


@pytest.mark.parametrize("longest", [None, 50.0, 5000.0])
def test_spans_of_every_length(spark, longest):
    rng = random.Random(12)
    spans = [(i, a := rng.uniform(-500, 500), a + rng.choice([0, 0.5, 3, 40, 700, 4000, -1])) for i in range(150)]
    points = [(i, rng.uniform(-600, 5000)) for i in range(400)] + [(1000 + i, s[1]) for i, s in enumerate(spans)] + [(2000 + i, s[2]) for i, s in enumerate(spans)]
    p = spark.createDataFrame([*points, (9999, None)], "p int, t double")
    s = spark.createDataFrame([*spans, (999, None, 5.0)], "s int, a double, b double")
    got = [tuple(r) for r in joins.interval_join(p, s, "t", "a", "b", 2.0, longest=longest).select("p", "s").collect()]
    assert sorted(got) == sorted((i, k) for i, t in points for k, a, b in spans if a <= t <= b)


def test_strategies_are_taken(spark):
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    plan = lambda s: joins.by_strategy(a, b, ["k"], s)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan("broadcast") and "SortMergeJoin" in plan("merge") and "ShuffledHashJoin" in plan("shuffle_hash")
    with pytest.raises(ValueError):
        joins.by_strategy(a, b, ["k"], "magic")


def test_first_links(spark):
    from pricelattice.operators import dedup

    page = '<a href="/x">Ankara</a><A class=c HREF="/y"><b>İzmir</b></A><a href="/x">again</a><a href="">none</a><a href="/z"> </a><a href="/tr">TÜRKİYE geneli</a>'
    l = html.links(spark.createDataFrame([(2, page), (1, '<a href="/y">first</a>')], "id int, h string"), "id", "h")
    got = {(r.href, r.name, r.id) for r in dedup.first_links(l, "href", "name", ["id", "pos"], without="geneli").collect()}
    assert got == {("/x", "Ankara", 2), ("/y", "first", 1)}


def test_parquet_by_years(spark, tmp_path):
    from pricelattice.sources import readers

    for y in (2016, 2017):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / f"w{y}"))
        next((tmp_path / f"w{y}").glob("part-*")).rename(tmp_path / f"weather_{y}.parquet")
    (tmp_path / "weather_2018.parquet").write_bytes(b"broken")
    got = readers.read_parquet_years(spark, str(tmp_path / "weather_*.parquet"), spark.range(1).schema)
    assert Counter(r.file_year for r in got.collect()) == {2016: 3, 2017: 3}
