"""Registered queries of names, places and series, each with its SQL oracle. They join the catalog's when this module is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelattice.operators import places, products, reshape, series
from pricelattice.plans.catalog import query
from pricelattice.session import table

ALIASES = [("small widget", "Widget, small", "Tool"), ("ring", "Ring", "Jewel"), ("gadget", "Gadget", "Tool"), ("red", "Red ware", "Colour"), ("big blue widget mk2", "Widget, blue", "Tool")]
_VALUES = ", ".join(f"({i}, '{a}', '{n}', '{c}')" for i, (a, n, c) in enumerate(ALIASES))


@query(rf"""with a(o, alias, name, category) as (values {_VALUES}), k as (select p_partkey, p_name, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) as key from part)
select p_partkey, coalesce(arg_min(name, case when alias = key then -1 else o end), any_value(array_to_string(list_transform(regexp_extract_all(trim(p_name), '\pL+|[^\pL]+'), lambda x: upper(x[1]) || lower(x[2:])), ''))) as product,
coalesce(arg_min(category, case when alias = key then -1 else o end), 'Diğer') as category from k left join a on contains(key, alias) or contains(alias, key) group by p_partkey""")
def product_aliases(spark, d):
    name, category = products.standard_product(F.col("p_name"), ALIASES)
    return table(spark, d, "part").select("p_partkey", name.alias("product"), category.alias("category"))


_ASKED = "select n_nationkey, r_name as city, n_name as district from nation join region on n_regionkey = r_regionkey"


def _asked(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("city"), F.col("n_name").alias("district"))


@query(f"""with q as ({_ASKED}), k as (select city, district, 36 + n_nationkey * 0.125::double as lat, 27 + n_nationkey * 0.25::double as lon from q where n_nationkey % 3 = 0),
s as (select q.*, s_suppkey as rank, case when s_suppkey % 4 = 0 then upper(district) else s_name end as found_district, 36 + s_suppkey * 0.0625::double as lat, 27 + s_suppkey * 0.03125::double as lon from q join supplier on s_nationkey = n_nationkey),
b as (select city, district, arg_min(lat, (found_district <> upper(district), rank)) as lat, arg_min(lon, (found_district <> upper(district), rank)) as lon from s group by 1, 2)
select q.city, q.district, coalesce(k.lat, b.lat) as lat, coalesce(k.lon, b.lon) as lon, case when k.lat is not null then 'known' when b.lat is not null then 'suggested' end as place_source
from q left join k using (city, district) left join b using (city, district)""")
def place_choice(spark, d):
    q = _asked(spark, d)
    known = q.filter("n_nationkey % 3 = 0").selectExpr("city", "district", "36 + n_nationkey * 0.125D as lat", "27 + n_nationkey * 0.25D as lon")
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey").join(q, "n_nationkey")
    s = s.selectExpr("city", "district", "s_suppkey as rank", "city as found_city", "if(s_suppkey % 4 = 0, upper(district), s_name) as found_district", "36 + s_suppkey * 0.0625D as lat", "27 + s_suppkey * 0.03125D as lon")
    return places.choose_place(q.select("city", "district"), known, s)


@query(f"""with q as ({_ASKED}), r as (select q.*, s_suppkey as rank, s_suppkey % 2 = 0 and s_suppkey % 3 <> 0 as border, s_suppkey % 5 = 0 as named, 36::double as south, 36 + (s_suppkey % 7) * 0.01::double as north, 27::double as west, 27 + (s_suppkey % 4) * 0.01::double as east
from q join supplier on s_nationkey = n_nationkey),
b as (select city, district, arg_min([south, north, west, east], (case when border and named then 1 when border then 2 else 3 end, rank)) as bbox from r where north - south >= 0.02::double and east - west >= 0.02::double group by 1, 2)
select q.city, q.district, bbox[1] as south, bbox[2] as north, bbox[3] as west, bbox[4] as east from q left join b using (city, district)""")
def bbox_choice(spark, d):
    q = _asked(spark, d)
    r = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey").join(q, "n_nationkey").selectExpr(
        "city", "district", "s_suppkey as rank", "if(s_suppkey % 2 = 0, 'boundary', 'place') as class", "if(s_suppkey % 3 <> 0, 'administrative', 'city') as type", "if(s_suppkey % 5 = 0, concat(district, ', x'), '-') as display_name",
        "array('36', string(36 + (s_suppkey % 7) * 0.01D), '27', string(27 + (s_suppkey % 4) * 0.01D)) as boundingbox",
    )
    b = places.choose_bbox(q.select("city", "district"), r)
    return b.select("city", "district", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("south", "north", "west", "east"))])


@query("""with g as (select s_suppkey, round(36 + s_suppkey % 5 + i.i * 0.25::double, 6) as lat, round(27 + j.j * 0.25::double, 6) as lon, 36 + s_suppkey % 5 + 0.5::double as a, 27.375::double as b from supplier, range(0, 5) i(i), range(0, 4) j(j))
select s_suppkey, lat, lon, cast(row_number() over (partition by s_suppkey order by (lat - a) * (lat - a) + (lon - b) * (lon - b), lat, lon) as int) as visit from g""")
def grid_from_centre(spark, d):
    b = table(spark, d, "supplier").selectExpr("s_suppkey", "36D + s_suppkey % 5 as south", "37D + s_suppkey % 5 as north", "27D as west", "27.75D as east", "36.5D + s_suppkey % 5 as lat0", "27.375D as lon0")
    return places.from_centre(reshape.grid_points(b, F.lit(0.25)), ["s_suppkey"], "lat0", "lon0").select("s_suppkey", "lat", "lon", "visit")


_TICKERS = {"A": "Accepted", "N": "New", "R": "Returned", "Z": "Never quoted"}


@query("""select strftime(cast(l_shipdate as date), '%Y-%m-%d') as date, l_returnflag as ticker, case l_returnflag when 'A' then 'Accepted' when 'N' then 'New' else 'Returned' end as commodity_name, max(l_tax) as open, max(l_extendedprice) as high, min(l_extendedprice) as low,
max(l_extendedprice) filter (where l_linestatus = 'F') as close, cast(count(*) as double) as volume, '2024-01-01T00:00:00' as _ingested_at from lineitem group by cast(l_shipdate as date), l_returnflag having max(l_extendedprice) filter (where l_linestatus = 'F') is not null""")
def quote_rows(spark, d):
    l = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    own = lambda t, c: F.when(F.col("l_returnflag") == t, F.col(c))
    quotes = lambda t: {"Open": F.max(own(t, "l_tax")), "High": F.max(own(t, "l_extendedprice")), "Low": F.min(own(t, "l_extendedprice")), "Close": F.max(F.when(F.col("l_linestatus") == "F", own(t, "l_extendedprice"))), "Volume": F.count_if(F.col("l_returnflag") == t)}
    wide = l.groupBy("day").agg(*[c.alias(f"{t}_{q}") for t in "ANR" for q, c in quotes(t).items()])
    return series.quote_rows(wide, _TICKERS, "day", "2024-01-01T00:00:00")


@query("""with s as (select o_orderstatus, cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as b from orders group by 1), w as (select *, cast(unnest(generate_series(a, b, interval 600 day)) as date) as window_start from s)
select o_orderstatus, window_start, least(window_start + 599, b) as window_end from w""")
def series_windows(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return series.request_windows(s, "a", "b", F.lit(1)).select("o_orderstatus", "window_start", "window_end")


@query("select event_type as series, strftime(ts, '%d-%m-%Y') as date, arg_min(value, event_id) as value, min(event_id) as event_id from events where event_id % 10 <> 0 and value is not null group by 1, 2")
def series_tidy(spark, d):
    value = F.when(F.col("event_id") % 10 == 0, "ND").otherwise(F.col("value").cast("string"))
    chunks = table(spark, d, "events").select(F.col("event_type").alias("series"), F.date_format("ts", "dd-MM-yyyy").alias("date"), value.alias("value"), "event_id")
    return series.tidy(chunks, "event_id").select("series", "date", "value", "event_id")
