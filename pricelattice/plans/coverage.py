"""Registered queries of nested products, energy merges, text fields, dates, weather rows, message parsing and links, each with its SQL
oracle. They join the catalog's when this module is imported."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pricelattice.functions import dates as D
from pricelattice.functions import numeric as N
from pricelattice.functions import text as X
from pricelattice.operators import dedup, html, joins, reshape, weather
from pricelattice.plans.catalog import query
from pricelattice.session import table
from pricelattice.sources import datasets, readers
from pricelattice.streaming import streams


def _r(c, n: int = 6):
    return F.round(c, n)


# ---- nested shapes --------------------------------------------------------------------------------------------------


@query("""select c_custkey as id, c_name as title, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then 'a' else 'a, ' || c_mktsegment end as categories, o_orderkey::varchar as "depotId", o_totalprice as price
from customer left join orders on o_custkey = c_custkey""")
def flatten_products(spark, d):
    """Customers as products whose orders are their depots; those without orders keep one row of nulls."""
    depots = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("depotId"), F.col("o_totalprice").alias("price"))).alias("list"))
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 3
    cats = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), seg))
    c = table(spark, d, "customer").withColumn("categories", cats).join(depots, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "categories", F.lit(0.0).alias("price"), F.col("list").alias("productDepotInfoList"))
    return reshape.flatten_depots(c).select("id", "title", "categories", "depotId", "price")


@query("select n_name as city, s_suppkey, s_acctbal from supplier join nation on n_nationkey = s_nationkey")
def map_of_city_rows(spark, d):
    """Rows by city in maps, one map a region, and back."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    lists = s.groupBy("n_regionkey", "n_name").agg(F.collect_list(F.struct("s_suppkey", "s_acctbal")).alias("rows"))
    maps = lists.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "rows"))).alias("data"))
    return reshape.map_of_lists(maps, "data")


# ---- energy ---------------------------------------------------------------------------------------------------------


def _json(**cols):
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))


@query("""with q as (select event_id, 'PH' || strftime(ts, '%y%m%d%H') || case when event_id % 2 = 0 then '' else '-0' || (event_id % 7)::varchar end as k, (event_id % 3)::varchar as t, value, event_type from events),
a as (select k, t, max(value) as x from q where event_type in ('view', 'click') group by 1, 2), b as (select k, t, max(value) as y from q where event_type in ('purchase', 'click') group by 1, 2)
select '20' || k[3:4] || '-' || k[5:6] || '-' || k[7:8] || 'T' || k[9:10] || ':00:00+03:00' as timestamp, t as "kontratTuru", k as "kontratAdi", round(x, 4) as "clearingQuantityAsk", round(y, 4) as volume from a full join b using (k, t)""")
def energy_contracts(spark, d):
    """Quantities and volumes of contracts, merged on contract; names of other shapes have no hour."""
    e = table(spark, d, "events")
    name = F.concat(F.lit("PH"), F.date_format("ts", "yyMMddHH"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("-0"), (F.col("event_id") % 7).cast("string"))))
    e = e.select("event_type", "value", name.alias("k"), (F.col("event_id") % 3).cast("string").alias("t"))

    def call(kinds, call_name, field):
        g = e.filter(F.col("event_type").isin(*kinds)).groupBy("k", "t").agg(F.max("value").alias("v"))
        return g.select(F.lit(call_name).alias("call"), _json(kontratTuru=F.col("t"), kontratAdi=F.col("k"), **{field: F.col("v")}).alias("record"))

    weeks = spark.range(1).select(F.lit("idm-qty").alias("call"), F.lit('{"kontratTuru": "w", "kontratAdi": "Week 3"}').alias("record"))
    raw = call(("view", "click"), "idm-qty", "clearingQuantityAsk").union(call(("purchase", "click"), "idm-volume", "volume")).union(weeks)
    rows, _ = datasets.dataset(raw, "intraday_market", "2024-02-01T00:00:00")
    return rows.select("timestamp", "kontratTuru", "kontratAdi", _r(F.col("clearingQuantityAsk"), 4).alias("clearingQuantityAsk"), _r(F.col("volume"), 4).alias("volume"))


@query("""select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+03:00' as timestamp, 'p' || user_id as province from events where event_type = 'error'""")
def energy_outages(spark, d):
    """The start becomes the time; the month's date goes."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    rec = _json(id=F.col("event_id"), date=F.lit("2024-01-01"), startTime=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), province=F.concat(F.lit("p"), F.col("user_id")))
    rows, _ = datasets.dataset(e.select(F.lit("planned-outages").alias("call"), rec.alias("record")), "planned_outages", "2024-02-01T00:00:00")
    return rows.select("id", "timestamp", "province")


@query("""with q as (select date_trunc('hour', ts) as h, count(*) as n from events where event_type = 'view' group by 1), p as (select date_trunc('hour', ts) as h, count(*) as m from events where event_type = 'click' group by 1)
select strftime(coalesce(q.h, p.h), '%Y-%m-%dT%H:00:00') || '+03:00' as timestamp, n::double as amount, m::double as price from q full join p using (h)""")
def energy_frequency(spark, d):
    """Amounts and prices of two calls, merged on their shared time columns."""
    e = table(spark, d, "events")

    def call(kind, call_name, field):
        g = e.filter(F.col("event_type") == kind).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").cast("double").alias("v"))
        return g.select(F.lit(call_name).alias("call"), _json(date=F.date_format("h", "yyyy-MM-dd'T'HH:mm:ss"), hour=F.date_format("h", "HH:mm"), **{field: F.col("v")}).alias("record"))

    rows, _ = datasets.dataset(call("view", "anc-pf-qty", "amount").union(call("click", "anc-pfk", "price")), "primary_frequency_capacity", "2024-02-01T00:00:00")
    return rows.select("timestamp", "amount", "price")


# ---- text and dates -------------------------------------------------------------------------------------------------


@query("""select p_partkey, case when p_partkey % 5 = 0 then null else p_retailprice end as tone, printf('%.2f ₺/Kg', p_retailprice) as label, round(p_retailprice, 2) as lo, case when p_partkey % 2 = 0 then round(p_retailprice, 2) + 10 else round(p_retailprice, 2) end as hi from part""")
def text_fields(spark, d):
    """First field of a comma list, a price label, and both ends of a price range."""
    price = F.col("p_retailprice")
    comma = lambda c: F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(","))
    tone = F.concat(F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(price.cast("string")), F.lit(",1,2"))
    span = F.when(F.col("p_partkey") % 2 == 0, F.concat(comma(price), F.lit(" - "), comma(F.round(price, 2) + 10))).otherwise(comma(price))
    lo, hi = X.price_range(span)
    return table(spark, d, "part").select("p_partkey", X.csv_field_double(tone).alias("tone"), X.price_label(price).alias("label"), lo.alias("lo"), _r(hi, 2).alias("hi"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then o_orderdate::date when 1 then o_orderdate::date end as file_day, (o_orderdate::date + interval 1 month)::date as next_month,
greatest(o_orderdate - interval 48 hour, timestamp '1998-01-01') as read_from from orders""")
def dates_of_files(spark, d):
    """Dates in file names, months added with the day clamped, and where an incremental read starts."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    name = F.when(k == 0, F.concat(F.lit("/a/prices_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".jsonl"))).when(k == 1, F.concat(F.lit("/a/hal_"), F.date_format(day, "dd_MM_yyyy"), F.lit(".csv"))).otherwise("/a/notes.txt")
    start = D.overlap_start(F.col("o_orderdate"), F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", D.date_in_path(name).alias("file_day"), F.add_months(day, 1).alias("next_month"), start.alias("read_from"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+03:00' as local_time, strftime(ts - interval 3 hour, '%Y%m%d%H%M%S') as utc_digits from events""")
def istanbul_times(spark, d):
    """Local text without an offset, and the same instant with one, as Istanbul time."""
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    at = D.any_timestamp(F.when(F.col("event_id") % 2 == 0, local).otherwise(F.concat(local, F.lit("+03:00"))))
    return table(spark, d, "events").select("event_id", D.istanbul_iso(at).alias("local_time"), F.date_format(at, "yyyyMMddHHmmss").alias("utc_digits"))


@query("select count(*) as n, true as within, true as spread, true as repeats from part")
def hash_noise(spark, d):
    """Noise of five percent: bounded, spread over its range, and the same again."""
    u, v = N.unit_noise(F.col("p_partkey"), F.lit("x")), N.unit_noise(F.col("p_partkey"), F.lit("x"))
    p = table(spark, d, "part").select(u.alias("u"), v.alias("v"))
    mean = F.abs(F.avg("u") - 1) < 0.005
    return p.agg(F.count("*").alias("n"), F.bool_and(F.col("u").between(0.95, 1.05)).alias("within"), (mean & (F.min("u") < 0.96) & (F.max("u") > 1.04)).alias("spread"), F.bool_and(F.col("u") == F.col("v")).alias("repeats"))


@query("""with h as (select user_id, list(value order by ts, event_id) as v from events where value is not null group by 1)
select user_id as city_id, round(v[1], 4) as t2m_max, round(v[2], 4) as t2m_min, round(v[1] / 3.6, 3) as sun, true as wind_ok, true as ps_ok from h where len(list_filter(v, lambda x: x < 400)) > 0""")
def weather_daily(spark, d):
    """Each user's events as an answer of the weather service: the first of a daily list, means of hourly ones without nulls, units."""
    e = table(spark, d, "events").filter("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("l"))
    v = F.transform("l", lambda x: x["value"])
    some = F.transform(v, lambda x: F.when(x < 400, x))
    daily = F.struct(v.alias("temperature_2m_max"), F.slice(v, 2, 1).alias("temperature_2m_min"), v.alias("precipitation_sum"), v.alias("shortwave_radiation_sum"))
    hourly = F.struct(some.alias("wind_speed_10m"), some.alias("relative_humidity_2m"), some.alias("surface_pressure"), some.alias("soil_moisture_0_to_7cm"))
    api = e.select(F.col("user_id").alias("city_id"), F.lit("x").alias("city_name"), daily.alias("daily"), hourly.alias("hourly"))
    mean = table(spark, d, "events").filter("value < 400").groupBy(F.col("user_id").alias("city_id")).agg(F.avg("value").alias("mean"))
    w = weather.daily_from_api(api).filter("ws10m is not null").join(mean, "city_id")
    return w.select("city_id", _r(F.col("t2m_max"), 4).alias("t2m_max"), _r(F.col("t2m_min"), 4).alias("t2m_min"), _r(F.col("allsky_sfc_sw_dwn"), 3).alias("sun"), (F.abs(F.col("ws10m") - F.col("mean")) <= 0.00006).alias("wind_ok"), (F.abs(F.col("ps") * 10 - F.col("ws10m")) <= 0.0006).alias("ps_ok"))


# ---- messages and sources -------------------------------------------------------------------------------------------


@query("""select event_type, count(*) filter (where event_id % 9 <> 0) as good, count(*) filter (where event_id % 9 = 0) as bad from events group by 1""")
def payload_dead_letters(spark, d):
    """Payloads of which every ninth is cut off, split into rows and dead letters."""
    body = F.to_json(F.struct("event_id", "event_type"))
    m = table(spark, d, "events").select(F.when(F.col("event_id") % 9 == 0, F.expr("substring(to_json(struct(event_id, event_type)), 1, 12)")).otherwise(body).alias("value"), "event_type")
    good, _ = streams.parse_payload(m.select("value"), streams.T.StructType.fromDDL("event_id bigint, event_type string"))
    ok = good.groupBy("event_type").agg(F.count("*").alias("good"))
    every = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 9 == 0).alias("cut"))
    return every.join(ok, "event_type").select("event_type", "good", (F.col("n") - F.col("good")).alias("bad"))


@query("select year(o_orderdate)::int as year, round(avg(o_totalprice), 4) as rate from orders where o_orderstatus = 'P' group by 1")
def rates_of_first_source(spark, d):
    """The first of three sources that has rows: here the second."""
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(_r(F.avg("o_totalprice"), 4).alias("rate"))
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select("year", "rate")
    return readers.first_nonempty([pick("none of it"), pick("P"), pick("O")], pick("F"))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) as name, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)))) as pos from pages),
f as (select *, row_number() over (partition by href order by page_id, pos) as k from l where trim(name) <> '' and href <> '' and not contains(lower(name), 'the')) select href, name, page_id from f where k = 1""")
def links_once(spark, d):
    """Every address once, from the first link to it; links with a word in their name that is not wanted go."""
    l = html.links(table(spark, d, "pages"), "page_id", "html")
    return dedup.first_links(l, "href", "name", ["page_id", "pos"], without="the").select("href", "name", "page_id")


@query("""select s as strategy, o_orderstatus, count(*) as n from orders join customer on c_custkey = o_custkey, (select unnest(['broadcast', 'merge', 'shuffle_hash', 'chosen']) as s) where c_acctbal > 0 group by 1, 2""")
def join_strategies(spark, d):
    """One join by each strategy that can be asked for, and by Spark's choice."""
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    frames = [joins.by_strategy(o, c, ["c_custkey"], s).groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit(s or "chosen").alias("strategy"), "o_orderstatus", "n") for s in ("broadcast", "merge", "shuffle_hash", None)]
    return readers.concat_by_name(frames)


@query("""select e.event_id, q.event_id as span_id from events e join events q on e.user_id = q.user_id
where e.event_type = 'purchase' and q.event_type = 'error' and e.ts >= q.ts and e.ts <= q.ts + (q.event_id % 9 * q.event_id % 9) * interval 7 hour""")
def interval_join_lengths(spark, d):
    """Spans from nothing to some days, on buckets of six hours and wider ones."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    length = F.expr("make_interval(0, 0, 0, 0, int(event_id % 9 * event_id % 9) * 7)")
    q = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("lo"), (F.col("ts") + length).alias("hi"))
    return joins.interval_join(e.filter("event_type = 'purchase'"), q, "ts", "lo", "hi", 6 * 3600, ["user_id"], longest=64 * 7 * 3600).select("event_id", "span_id")
