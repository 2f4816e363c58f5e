"""Registered queries of similarity, two-stream alerts, the speed layer, energy records, places on the sphere, state, sketches, nested
cards, catalogue walks, wholesale history and names, each with its SQL oracle. They join the catalog's when this module is imported."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pricelattice.functions import news, provinces
from pricelattice.operators import catalogue, cells, html, joins, pricing, similarity, sketches, wholesale
from pricelattice.plans.catalog import query
from pricelattice.session import table
from pricelattice.sources import datasets, state
from pricelattice.streaming import alerts, speed


def _r(c, n: int = 6):
    return F.round(c, n)


# ---- names ----------------------------------------------------------------------------------------------------------

_BAGS = r"""with t as (select list_sort(list_filter(regexp_split_to_array(trim(lower(translate(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size, 'İI', 'ii'))), '[^\pL\pN]+'), lambda x: x <> '')) as w from part),
b as (select w, array_to_string(w, ' ') as bag, count(*) as n from t where len(w) > 0 group by 1, 2),
tf as (select bag, n, unnest(list_distinct(w)) as word, w from b), df as (select word, sum(n) as df from tf group by 1),
raw as (select bag, n, tf.word, len(list_filter(w, lambda x: x = tf.word)) * (ln((select count(*) from t) / df) + 1) as w from tf join df on tf.word = df.word),
v as (select bag, n, word, w / sqrt(sum(w * w) over (partition by bag)) as w from raw)"""


@query(_BAGS + """ select a.bag as bag_a, b.bag as bag_b, round(sum(a.w * b.w), 6) as similarity, a.n::bigint as rows_a, b.n::bigint as rows_b
from v a join v b on a.word = b.word and a.bag < b.bag group by a.bag, b.bag, a.n, b.n having sum(a.w * b.w) >= 0.8 - 1e-9""")
def tfidf_similar_names(spark, d):
    """Every part, by the words of its name, type, brand and size."""
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string")).alias("title"))
    out = similarity.tfidf_names(p, "title", 0.8)
    return out.select("bag_a", "bag_b", _r(F.col("similarity")).alias("similarity"), "rows_a", "rows_b")


# ---- streams (batch twins) ------------------------------------------------------------------------------------------


@query("""with r as (select user_id as k, ts, value as p from events where event_type = 'purchase' and value is not null), w as (select user_id as k, ts, value as p from events where event_type = 'view' and value is not null),
a as (select r.k, r.ts, r.p, w.p as now from r asof left join w on r.k = w.k and r.ts >= w.ts), l as (select *, lag(p) over x as pr, lag(now) over x as wp, lag(ts) over x as pt from a window x as (partition by k order by ts, p))
select k as user_id, ts as at, pr as prev_retail, p as retail, wp as prev_wholesale, now as wholesale from l where ts - pt <= interval 48 hour and pr > 0 and p >= pr * 1.5 and wp > 0 and abs(now - wp) <= wp * 0.4""")
def retail_jump_wholesale_flat(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = alerts.jumps_batch(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), "user_id", "at", "value", 0.5, 0.4)
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "prev_retail", "retail", "prev_wholesale", "wholesale")


def weather_of(events):
    """Views as weather messages: some values are impossible or missing."""
    w = events.filter("event_type = 'view'").selectExpr(
        "user_id as city_id", "cast(ts as timestamp) as at", "value % 50 - 20 as t2m_min", "case when event_id % 11 = 0 then double('nan') else value % 50 - 12 end as t2m_max",
        "case when event_id % 7 = 0 then -1.0D else value % 40 end as rain", "900 + value % 300 as pressure", "case when event_id % 5 = 0 then null else value % 30 end as radiation",
    )
    return w


@query("""with w as (select user_id as city_id, ts, value % 50 - 20 as lo, case when event_id % 11 = 0 then null else value % 50 - 12 end as hi, case when event_id % 7 = 0 then null else value % 40 end as rain,
case when 900 + value % 300 <= 1100 then 900 + value % 300 end as hpa, case when event_id % 5 = 0 then null else value % 30 end as mj from events where event_type = 'view' and user_id is not null),
p as (select user_id, ts, value from events where event_type = 'purchase')
select w.city_id, w.ts as weather_at, p.ts as price_at, round(p.value, 4) as price, round(least(lo, hi), 4) as t2m_min, round(greatest(lo, hi), 4) as t2m_max, round(rain, 4) as rain, round(hpa / 10, 4) as ps, round(mj / 3.6, 3) as sun,
coalesce(least(lo, hi) <= 0, false) as frost, coalesce(rain >= 20, false) as heavy_rain, c_mktsegment as segment
from w join p on p.user_id = w.city_id and p.ts >= w.ts and p.ts < w.ts + interval 6 hour left join customer on c_custkey = w.city_id where lo is not null or hi is not null or rain is not null""")
def speed_layer(spark, d):
    e = table(spark, d, "events")
    prices = e.filter("event_type = 'purchase'").selectExpr("user_id as city_id", "cast(ts as timestamp) as price_at", "value as price")
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("city_id"), F.col("c_mktsegment").alias("segment"))
    out = speed.speed_layer(weather_of(e), prices, places)
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("city_id", at("weather_at"), at("price_at"), *[_r(F.col(c), 4).alias(c) for c in ("price", "t2m_min", "t2m_max", "rain", "ps")], _r(F.col("allsky_sfc_sw_dwn"), 3).alias("sun"), "frost", "heavy_rain", "segment")


# ---- energy records -------------------------------------------------------------------------------------------------


def _records(spark, d):
    """Events as answers of the 'kgup' call; some have an unknown field, a value of another type, no time, or are no object."""
    kind = F.col("event_id") % 50
    fields = {"date": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "time": F.date_format("ts", "HH:mm"), "plantId": F.col("event_id"), "toplam": F.col("value")}
    plain = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    more = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()], F.lit(1).alias("extra")))
    typed = F.to_json(F.struct(*[(F.lit("many") if k == "toplam" else c).alias(k) for k, c in fields.items()]))
    timeless = F.to_json(F.struct(fields["plantId"].alias("plantId"), fields["toplam"].alias("toplam")))
    record = F.when(kind == 1, more).when(kind == 2, typed).when(kind == 3, timeless).when(kind == 4, F.lit("[1, 2]")).when(kind == 5, F.lit("{broken")).otherwise(plain)
    return table(spark, d, "events").select(F.when(kind == 6, "rt-gen").otherwise("kgup").alias("call"), record.alias("record"))


@query("""select event_id as "plantId", strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+03:00' as timestamp, 'kgup' as _dataset, round(value, 4) as toplam from events where event_id % 50 not between 1 and 6""")
def energy_records(spark, d):
    rows, _ = datasets.dataset(_records(spark, d), "kgup", "2024-02-01T00:00:00")
    return rows.select("plantId", "timestamp", "_dataset", _r(F.col("toplam"), 4).alias("toplam"))


@query("""select case event_id % 50 when 1 then 'unknown: extra' when 2 then 'type: toplam' when 3 then 'no time' when 6 then 'unknown call' else 'no object' end as drift, count(*) as n from events where event_id % 50 between 1 and 6 group by 1""")
def energy_quarantine(spark, d):
    return datasets.typed(_records(spark, d), "kgup")[1].groupBy("drift").agg(F.count("*").alias("n"))


# ---- places ---------------------------------------------------------------------------------------------------------

_SPHERE = ("(({k} * 7919) % 1801) / 10.0 - 90", "(({k} * 104729) % 3601) / 10.0 - 180")
_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))))"


def _on_sphere(df, k):
    lat, lon = (x.format(k=k).replace("10.0", "10D") for x in _SPHERE)  # in doubles, as SQL divides
    return df.select(k, F.expr(f"double({lat})").alias("lat"), F.expr(f"double({lon})").alias("lon"))


def _sphere_sql(t, k):
    return f"select {k}, ({_SPHERE[0].format(k=k)})::double as lat, ({_SPHERE[1].format(k=k)})::double as lon from {t}"


@query(f"""with p as ({_sphere_sql('customer', 'c_custkey')}), s as ({_sphere_sql('supplier', 's_suppkey')}), h as (select c_custkey, s_suppkey, {_HAV} as km from p, s)
select c_custkey, s_suppkey, round(km, 5) as distance_km from h where km <= 1500 qualify row_number() over (partition by c_custkey order by km, s_suppkey) = 1""")
def nearest_on_sphere(spark, d):
    """Points from pole to pole and around the date line."""
    p, s = _on_sphere(table(spark, d, "customer"), "c_custkey"), _on_sphere(table(spark, d, "supplier"), "s_suppkey")
    return joins.nearest_site(p, s, 1500.0, "c_custkey", "s_suppkey").withColumn("distance_km", _r(F.col("distance_km"), 5))


@query(f"""with p as ({_sphere_sql('customer', 'c_custkey')}), s as ({_sphere_sql('supplier', 's_suppkey')}), h as (select c_custkey, s_suppkey, {_HAV} as km from p, s)
select c_custkey, s_suppkey, round(km, 5) as distance_km, case when km <= 250 then 250.0 when km <= 1000 then 1000.0 else 4000.0 end as radius_km from h where km <= 4000 qualify row_number() over (partition by c_custkey order by km, s_suppkey) = 1""")
def nearest_growing_radius(spark, d):
    p, s = _on_sphere(table(spark, d, "customer"), "c_custkey"), _on_sphere(table(spark, d, "supplier"), "s_suppkey")
    return joins.nearest_with_fallback(p, s, "c_custkey", "s_suppkey", (250.0, 1000.0, 4000.0)).withColumn("distance_km", _r(F.col("distance_km"), 5))


@query(f"""with p as ({_sphere_sql('customer', 'c_custkey')}), s as ({_sphere_sql('supplier', 's_suppkey')}), h as (select s_suppkey, {_HAV} as km from p, s)
select s_suppkey, count(*) as customers from h where km <= 700 group by 1""")
def customers_within(spark, d):
    p, s = _on_sphere(table(spark, d, "customer"), "c_custkey"), _on_sphere(table(spark, d, "supplier"), "s_suppkey")
    return cells.counts_within(p, s, 700.0, "s_suppkey", "customers")


# ---- state ----------------------------------------------------------------------------------------------------------

_SEEN = "select event_type, max(ts) as last from events where ts < timestamp '2024-01-20' + (length(event_type)::int) * interval 12 hour and event_type <> 'click' group by 1"


def _seen(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'click' and ts < timestamp_ntz '2024-01-20' + make_interval(0, 0, 0, 0, length(event_type) * 12)")
    return state.advanced(None, e, "event_type", "ts")


@query(f"""with s as ({_SEEN}) select event_id, e.event_type from events e left join s on s.event_type = e.event_type
where e.ts >= coalesce(greatest(last - interval 48 hour, timestamp '2024-01-05'), timestamp '2024-01-05')""")
def incremental_rows_due(spark, d):
    """A kind that was never seen is read from the floor on, the others from 48 hours before their newest row."""
    return state.due(table(spark, d, "events"), _seen(spark, d), "event_type", "ts", dt.datetime(2024, 1, 5), 48).select("event_id", "event_type")


@query(f"with s as ({_SEEN}) select event_type, 'minutes' as rule from s where timestamp '2024-01-22 12:00:00' - last >= interval 2160 minute union all select event_type, 'days' from s where date '2024-01-22' - last::date >= 1")
def stale_keys(spark, d):
    s = _seen(spark, d)
    now = F.lit(dt.datetime(2024, 1, 22, 12)).cast("timestamp")
    a, b = state.stale(s, now, 2160), state.stale_days(s, F.lit(dt.date(2024, 1, 22)))
    return a.select("event_type", F.lit("minutes").alias("rule")).unionByName(b.select("event_type", F.lit("days").alias("rule")))


# ---- sketches -------------------------------------------------------------------------------------------------------


@query("select l_returnflag, count(*) as n, count(distinct date_trunc('month', l_shipdate)) as partitions, true as distinct_ok, true as median_ok, true as p90_ok from lineitem group by 1")
def merged_sketches(spark, d):
    """Sketches of every month, merged; their estimates lie within four standard errors, their quantiles within the error of rank."""
    l = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice", F.date_trunc("month", "l_shipdate").alias("month"))
    monthly = sketches.sketched(l, ["l_returnflag", "month"], "l_partkey", "l_extendedprice")
    est = sketches.estimates(sketches.merged(monthly, ["l_returnflag"]), ["l_returnflag"], (0.5, 0.9))
    parts = monthly.groupBy("l_returnflag").agg(F.count("*").alias("partitions"))
    j = l.join(est.drop("n"), "l_returnflag")
    below = lambda q: F.avg((F.col("l_extendedprice") <= F.col(q)).cast("double"))
    truth = j.groupBy("l_returnflag", "distinct_estimate").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("exact"), below("q50").alias("b50"), below("q90").alias("b90"))
    ok = lambda c, q: F.abs(F.col(c) - q) <= sketches.KLL_ERROR + 1 / F.col("n")
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) <= 4 * sketches.HLL_ERROR * F.col("exact") + 1
    return truth.join(parts, "l_returnflag").select("l_returnflag", "n", "partitions", near.alias("distinct_ok"), ok("b50", 0.5).alias("median_ok"), ok("b90", 0.9).alias("p90_ok"))


# ---- pages and catalogues -------------------------------------------------------------------------------------------


@query(r"""with p as (select page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<li\b[^>]*>(.*?)</li>', 1) as c from pages)
select page_id, (i - 1)::int as card_no, 1 as depth, trim(regexp_replace(regexp_replace(c[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as card_text from (select page_id, c, unnest(range(1, len(c) + 1)) as i from p)""")
def html_list_cards(spark, d):
    cards = html.nested_cards(table(spark, d, "pages"), "page_id", "html", "li")
    return cards.select("page_id", F.col("card_no").cast("int").alias("card_no"), "depth", F.trim(F.regexp_replace(F.regexp_replace("inner", "<[^>]*>", " "), r"\s+", " ")).alias("card_text"))


_NODES = "select null as parent, 'R' || r_regionkey as code, r_name as name, 'category' as kind from region union all select 'R' || n_regionkey, 'N' || n_nationkey, n_name, 'group' from nation union all select 'N' || s_nationkey, 'S' || s_suppkey, s_name, 'series' from supplier"


def _nodes(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    r = table(spark, d, "region").select(F.lit(None).cast("string").alias("parent"), key("R", "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("category").alias("kind"))
    n = table(spark, d, "nation").select(key("R", "n_regionkey"), key("N", "n_nationkey"), "n_name", F.lit("group"))
    s = table(spark, d, "supplier").select(key("N", "s_nationkey"), key("S", "s_suppkey"), "s_name", F.lit("series"))
    return r.union(n).union(s)


@query(f"""with recursive n as ({_NODES}), t as (select code, name, kind, 0 as level, name as path from n where parent is null union all select n.code, n.name, n.kind, t.level + 1, t.path || ' / ' || n.name from t join n on n.parent = t.code)
select code, name, kind, level, path from t""")
def catalogue_tree(spark, d):
    return catalogue.walk(_nodes(spark, d)).select("code", "name", "kind", "level", "path")


@query("select 'S' || s_suppkey as code, s_name as name, r_name || ' / ' || n_name || ' / ' || s_name as path from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_regionkey = 1")
def catalogue_series(spark, d):
    return catalogue.series_of(_nodes(spark, d), "R1")


# ---- prices ---------------------------------------------------------------------------------------------------------

_CITIES, _GOODS = ["Antalya", "İstanbul", "ANKARA", "Erzurum", "İZMİR", "Gaziantep", "Rize", "Tokat"], ["Domates", "Karpuz", "Çilek", "Kiraz", "Portakal", "Üzüm", "Elma (Golden)", "Soğan"]


@query("""with b as (select s_suppkey, s_suppkey % 8 as c, s_suppkey // 8 % 8 as g, case when s_suppkey // 8 % 8 in (0, 7) then 'Sebze' else 'Meyve' end as kategori, 20 + s_suppkey % 50 + 0.1414213562373095::double as lo, 50 + s_suppkey % 70 + 0.1414213562373095::double as hi from supplier),
place(c, veg, fruit) as (values (0, 0.80, 0.865), (1, 0.975, 0.975), (2, 1.05, 1.08), (3, 1.20, 1.225), (4, 0.865, 0.885), (5, 0.875, 0.925), (6, 1.085, 1.015), (7, 1.0, 1.0)),
season(g, m) as (values (0, [1.30, 1.3 - 0.65/6, 1.3 - 1.3/6, 1.3 - 1.95/6, 1.3 - 2.6/6, 1.3 - 3.25/6, 0.65, 0.65 + 0.65/6, 0.65 + 1.3/6, 0.65 + 1.95/6, 0.65 + 2.6/6, 0.65 + 3.25/6]),
  (1, [1.5, 1.5, 1.5 - 0.92/5, 1.5 - 1.84/5, 1.5 - 2.76/5, 1.5 - 3.68/5, 0.58, 0.58 + 0.92/6, 0.58 + 1.84/6, 0.58 + 2.76/6, 0.58 + 3.68/6, 0.58 + 4.6/6]),
  (2, [1.5, 1.3, 1.1, 0.9, 0.7, 0.7, 0.7 + 0.8/6, 0.7 + 1.6/6, 0.7 + 2.4/6, 0.7 + 3.2/6, 0.7 + 4.0/6, 1.5]), (3, [1.5, 1.5, 1.5 - 0.7/3, 1.5 - 1.4/3, 0.8, 0.8, 0.8 + 0.7/6, 0.8 + 1.4/6, 0.8 + 2.1/6, 0.8 + 2.8/6, 0.8 + 3.5/6, 1.5]),
  (4, [0.8, 0.8 + 0.55/6, 0.8 + 1.1/6, 0.8 + 1.65/6, 0.8 + 2.2/6, 0.8 + 2.75/6, 1.35, 1.24, 1.13, 1.02, 0.91, 0.8]), (5, [1.5, 1.5, 1.5 - 0.82/5, 1.5 - 1.64/5, 1.5 - 2.46/5, 1.5 - 3.28/5, 0.68, 0.68, 0.68 + 0.82/4, 0.68 + 1.64/4, 0.68 + 2.46/4, 1.5]),
  (6, [0.88, 0.93, 0.98, 1.03, 1.08, 1.13, 1.18, 1.18 - 0.4/3, 1.18 - 0.8/3, 0.78, 0.78, 0.83]), (7, [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1])),
idx(y, f) as (values (2016, 1.0), (2017, 1.2054), (2018, 1.4018), (2019, 1.7232), (2020, 1.7679), (2021, 2.0982), (2022, 4.3750), (2023, 7.6786), (2024, 12.500), (2025, 17.411), (2026, 26.339)),
r as (select s_suppkey, make_date(2016 + k // 4, k % 4 * 3 + 1 + s_suppkey % 3, 15) as tarih, lo, hi, (f::double / 26.339::double) * (case kategori when 'Sebze' then veg else fruit end)::double as a, m::double[] as m from b join place using (c) join season using (g), range(0, 44) t(k) join idx on y = 2016 + k // 4)
select s_suppkey, tarih, round(greatest(lo * (a * m[month(tarih)]), 0.01), 2) as en_dusuk, round(greatest(hi * (a * m[month(tarih)]), 0.01), 2) as en_yuksek from r""")
def wholesale_history(spark, d):
    """Without noise, every third month of eleven years."""
    at = lambda names, k: F.get(F.array(*map(F.lit, names)), F.expr(k))
    b = table(spark, d, "supplier").select("s_suppkey", at(_CITIES, "int(s_suppkey % 8)").alias("sehir"), at(_GOODS, "int(s_suppkey div 8 % 8)").alias("urun"), F.expr("case when s_suppkey div 8 % 8 in (0, 7) then 'Sebze' else 'Meyve' end").alias("kategori"), F.expr("20 + s_suppkey % 50 + 0.1414213562373095D").alias("en_dusuk"), F.expr("50 + s_suppkey % 70 + 0.1414213562373095D").alias("en_yuksek"))
    days = F.expr("transform(sequence(0, 43), k -> make_date(2016 + k div 4, int(k % 4 * 3 + 1 + s_suppkey % 3), 15))")
    return wholesale.history(b, days, noise=False).select("s_suppkey", "tarih", "en_dusuk", "en_yuksek")


@query("""with t(target) as (values (date '2023-02-10'), (date '2025-01-01'), (date '2025-01-15'), (date '2025-04-20'), (date '2026-04-21'), (date '2026-05-01')), r(y, rate) as (values (2023, 0.65), (2024, 0.6), (2025, 0.4)),
w as (select target, day, coalesce(rate, 0.3)::double as rate, row_number() over (partition by target order by day) as k, count(*) over (partition by target) as n from (select target, unnest(generate_series(target, date '2026-04-21', interval 1 day))::date as day from t where target < date '2026-04-22') left join r on year(day) = y),
near as (select target, exp(sum(ln(1 + rate / 365))) as f, max(n) as n from w where k <= 401 or n - 401 <= 30 group by 1),
far as (select target, case when n - 401 > 30 then pow(1 + (select avg(coalesce(rate, 0.3)::double) from range(year(target + 401), year(target + 401) + floor((n - 401) / 365.0)::int + 1) x(yr) left join r on y = yr), (n - 401) / 365.0::double) else 1 end as g from near),
f as (select t.target, coalesce(1 / (near.f * far.g), 1) as f, date_trunc('month', t.target) as m from t left join near using (target) left join far using (target)),
m as (select m, arg_min(f, target) as f from f group by 1),
p as (select p_partkey::varchar as id, p_retailprice as price, case p_partkey % 3 when 0 then [1.25,1.25,1.25,1.25,1.25,1.0,0.8,0.8,0.8,0.8,1.0,1.25] when 1 then [1.25,1.25,1.25,1.25,1.0,0.8,0.8,1.0,1.25,1.25,1.25,1.25] else [1.20,1.15,1.05,0.95,0.90,0.85,0.82,0.83,0.88,0.95,1.08,1.18] end::double[] as s from part)
select id, f.target as target_date, round(greatest(price * (m.f * (s[month(f.target)] / s[4])), 0.01), 2) as price from p, f join m using (m)""")
def backcast_noise_free(spark, d):
    """Back-casting without noise, one target far enough that the rest compounds by years."""
    days = [dt.date(2023, 2, 10), dt.date(2025, 1, 1), dt.date(2025, 1, 15), dt.date(2025, 4, 20), dt.date(2026, 4, 21), dt.date(2026, 5, 1)]
    dim = pricing.deflation_dim(spark, dt.date(2026, 4, 22), days, {2023: 0.65, 2024: 0.6, 2025: 0.4})
    title = F.when(F.col("p_partkey") % 3 == 0, "Sofralık Domates").when(F.col("p_partkey") % 3 == 1, "Kiraz").otherwise("ekmek")
    base = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), title.alias("title"), F.lit("d1").alias("depotId"), F.col("p_retailprice").alias("price"))
    return pricing.backcast(base, dim, 4, noise=False).select("id", "target_date", "price")


# ---- filters and names ----------------------------------------------------------------------------------------------

_LIKE = lambda c, parts: "(" + " or ".join(f"{c} like '%{p}%'" for p in parts) + ")"
_STORY = "select c_custkey, '1#' || chr(65 + (c_custkey % 26)::int) || chr(65 + (c_custkey // 26 % 26)::int) || '#' || (case c_custkey % 19 when 0 then 'Ankara, Turkey' when 1 then 'turkey' when 2 then 'Spain' else '' end) as places, ['ECON_INFLATION,3', 'FOODxSECURITY;TAX', 'SPORT', 'ENV_DROUGHT', 'WB_2670_JOBS', 'ELECTION', ''][c_custkey % 7 + 1] as themes from customer"


@query(f"select c_custkey from ({_STORY}) where {_LIKE('places', news.LOCATIONS)} and {_LIKE('themes', news.THEMES)}")
def news_of_food_and_prices(spark, d):
    letter = lambda e: F.char(65 + F.expr(e))
    k = F.col("c_custkey") % 19
    named = F.when(k == 0, "Ankara, Turkey").when(k == 1, "turkey").when(k == 2, "Spain").otherwise("")
    places = F.concat(F.lit("1#"), letter("c_custkey % 26"), letter("c_custkey div 26 % 26"), F.lit("#"), named)
    themes = F.get(F.array(*map(F.lit, ["ECON_INFLATION,3", "FOODxSECURITY;TAX", "SPORT", "ENV_DROUGHT", "WB_2670_JOBS", "ELECTION", ""])), (F.col("c_custkey") % 7).cast("int"))
    c = table(spark, d, "customer").select("c_custkey", places.alias("places"), themes.alias("themes"))
    return c.filter(news.wanted(F.col("places"), F.col("themes"))).select("c_custkey")


_NAMES = ", ".join(f"'{p}'" for p in provinces.PROVINCES)


@query(f"""with n as (select c_custkey, [{_NAMES}, 'PARIS'][c_custkey % 82 + 1] as name from customer), s as (select *, case name when 'AFYONKARAHİSAR' then 'AFYON' when 'KAHRAMANMARAŞ' then 'K.MARAS' when 'MERSİN' then 'İÇEL' when 'PARIS' then null
when 'ELAZIĞ' then name when 'GAZİANTEP' then name when 'MARDİN' then name when 'NİĞDE' then name when 'SİNOP' then name when 'ŞANLIURFA' then name else translate(name, 'ÇĞİÖŞÜ', 'CGIOSU') end as spelled from n)
select c_custkey, spelled, case when name <> 'PARIS' then name end as back from s""")
def province_spellings(spark, d):
    """Names in lower case by Turkish letters to the service's spelling and back."""
    name = F.get(F.array(*map(F.lit, [*provinces.PROVINCES, "PARIS"])), (F.col("c_custkey") % 82).cast("int"))
    low = F.lower(F.translate(name, "Iİ", "ıi"))
    c = table(spark, d, "customer").select("c_custkey", F.when(name == "PARIS", "paris").otherwise(low).alias("name"))
    return c.withColumn("spelled", provinces.service_name(F.col("name"))).select("c_custkey", "spelled", provinces.province_of(F.col("spelled")).alias("back"))
