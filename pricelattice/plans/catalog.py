"""Registered queries on the driver's tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.functions import dates as D
from pricelattice.functions import numeric as N
from pricelattice.functions import text as X
from pricelattice.operators import dedup, gold, joins, pricing, ranking, reshape, windows
from pricelattice.session import table
from pricelattice.sources import readers
from pricelattice.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


def _day(c: str = "ts"):
    return F.to_date(c)


# ---- flagship -------------------------------------------------------------------------------------------------------


@query("""
select p_brand, cast(year(o_orderdate) as int) as order_year, round(avg(l_extendedprice / l_quantity / p_retailprice - 1), 6) as avg_markup,
       count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
where l_quantity > 0 and p_retailprice > 0 group by 1, 2""")
def markup_by_brand_year(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount").filter("l_quantity > 0")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("order_year"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice").filter("p_retailprice > 0")
    j = l.join(p, "l_partkey").join(o, "l_orderkey")
    m = N.markup(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"))
    return j.groupBy("p_brand", "order_year").agg(_r(F.avg(m)).alias("avg_markup"), F.count("*").alias("n"), _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ---- scans, filters, projections ------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1997-02-01' and l_quantity < 10")
def scan_pushdown_date_range(spark, d):
    return table(spark, d, "lineitem").filter("l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1997-02-01' and l_quantity < 10").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select doc_id, lang, n_chars from documents where (text like '%AKIA%' or text like '%password%' or text like '%the%and%') and lang like 'e_'")
def filter_or_like(spark, d):
    t = table(spark, d, "documents")
    return t.filter(X.like_any(F.col("text"), ["%AKIA%", "%password%", "%the%and%"]) & F.col("lang").like("e_")).select("doc_id", "lang", "n_chars")


@query("select count(*) as n from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11'")
def count_one_partition(spark, d):
    return table(spark, d, "events").filter("ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-11'").agg(F.count("*").alias("n"))


@query("select event_id, user_id, value from events where value is not null and value > 0 and event_type not in ('error', 'click')")
def filter_valid_values(spark, d):
    return table(spark, d, "events").filter((F.col("value") > 0) & ~F.col("event_type").isin("error", "click")).select("event_id", "user_id", "value")


@query("select o_orderkey, cast(o_orderdate as date) as order_date, strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%m') as month, strftime(o_orderdate, '%d') as day from orders")
def partition_columns(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("order_date")).withColumns(D.partition_text(F.col("order_date")))


@query("select event_id, event_type, user_id, 'events' as _dataset, 'driver' as _source, true as _synthetic from events where event_type = 'purchase'")
def enrich_constants(spark, d):
    return table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "event_type", "user_id").withColumns({"_dataset": F.lit("events"), "_source": F.lit("driver"), "_synthetic": F.lit(True)})


@query("""select event_id, coalesce(b.k, a.k) as k, a.event_type as event_type from (select event_id, event_type, cast(-1 as bigint) as k from events) a
join (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events) b using (event_id)""")
def struct_merge_right_wins(spark, d):
    e = table(spark, d, "events").withColumn("_d", F.from_json("props", "k bigint")).withColumn("k", F.lit(-1).cast("bigint"))
    return e.select("event_id", F.coalesce("_d.k", "k").alias("k"), "event_type")


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events where json_extract(props, '$.k') is not null")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k is not null")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_struct_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select max(cast(ts as date)) as base_day, count(*) as n from events where cast(ts as date) = (select max(cast(ts as date)) from events)")
def latest_partition(spark, d):
    e = table(spark, d, "events").withColumn("day", _day())
    return readers.latest_partition(e, "event_type", "day").groupBy(F.col("day").alias("base_day")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n from events where cast(ts as date) = date '2024-01-05' group by 1")
def wanted_partition(spark, d):
    """The wanted date counts, though every key has newer ones."""
    e = table(spark, d, "events").withColumn("day", _day())
    return readers.latest_partition(e, "event_type", "day", "2024-01-05").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""select event_id, case when event_id % 2 = 0 then strftime(ts, 'PH%y%m%d%H') else strftime(ts, 'PB%y%m%d%H-03') end as contract, date_trunc('hour', ts) - interval 3 hour as at from events""")
def contract_hours(spark, d):
    """Hourly and block contracts of Istanbul time, which has been three hours ahead since 2016."""
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "PH").otherwise("PB"), F.date_format("ts", "yyMMddHH"), F.when(F.col("event_id") % 2 == 0, "").otherwise("-03"))
    return table(spark, d, "events").select("event_id", name.alias("contract")).withColumn("at", D.contract_hour(F.col("contract")).cast("timestamp_ntz"))


@query(r"select page_id, (i - 1)::int as card_no, trim(regexp_replace(regexp_replace(c[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as card_text from (select page_id, c, unnest(range(1, len(c) + 1)) as i from (select page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1) as c from pages))")
def html_card_text(spark, d):
    """Every link of every page."""
    return readers.html_cards(table(spark, d, "pages"), "html", "a").select("page_id", "card_no", "card_text")


@query("select page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def html_title_host(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


# ---- joins ----------------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_join_new_rows(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.append_new(o, table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join_membership(spark, d):
    return dedup.only_known(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").filter("quality = 1"), ["doc_id"])


@query("""with a as (select nullif(c_nationkey, 3) as k, count(*) as n_c from customer group by 1), b as (select nullif(s_nationkey, 3) as k, count(*) as n_s from supplier where s_nationkey > 1 group by 1)
select coalesce(a.k, b.k) as k, n_c, n_s from a full join b on a.k is not distinct from b.k""")
def full_outer_null_keys(spark, d):
    k = lambda c: F.nullif(F.col(c), F.lit(3)).alias("k")
    a = table(spark, d, "customer").groupBy(k("c_nationkey")).agg(F.count("*").alias("n_c"))
    b = table(spark, d, "supplier").filter("s_nationkey > 1").groupBy(k("s_nationkey")).agg(F.count("*").alias("n_s"))
    return joins.full_outer_null_safe(a, b, ["k"])


@query("select n_name, r_name, count(*) as customers from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2")
def dimension_lookup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return joins.lookup(per, n, ["c_nationkey"]).groupBy("n_name", "r_name").agg(F.sum("customers").alias("customers"))


RULES = [(["ring"], "jewel"), (["widget", "gadget"], "tool"), (["small"], "little"), (["red", "blue"], "colour")]


@query("select p_partkey, case when contains(p_name, 'ring') then 'jewel' when contains(p_name, 'widget') or contains(p_name, 'gadget') then 'tool' when contains(p_name, 'small') then 'little' when contains(p_name, 'red') or contains(p_name, 'blue') then 'colour' else 'other' end as category from part")
def first_rule_wins(spark, d):
    return table(spark, d, "part").select("p_partkey", X.first_rule(F.col("p_name"), RULES, "other").alias("category"))


@query("select p_partkey, case when contains(k, 'ring') or contains('ring', k) then 'jewel' when contains(k, 'widget') or contains('widget', k) then 'tool' end as category from (select p_partkey, lower(trim(p_name)) as k from part)")
def alias_substring_rule(spark, d):
    return table(spark, d, "part").select("p_partkey", joins.first_rule_join(X.plain_key(F.col("p_name")), [(0, "ring", "jewel"), (1, "widget", "tool")]).alias("category"))


@query("""select p.event_id, s.event_id as asof_event_id, s.ts as asof_ts from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'signup') s on p.user_id = s.user_id and p.ts >= s.ts""")
def asof_last_signup(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), "ts", ["user_id"], ["event_id"]).select("event_id", "asof_event_id", "asof_ts")


@query(ORACLES["asof_last_signup"])
def asof_hot_keys(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return joins.bucketed_asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), "ts", ["user_id"], ["event_id"]).select("event_id", "asof_event_id", "asof_ts")


@query("""with s as (select cast(ts as date) as day, round(sum(value), 4) as v from events group by 1),
p as (select cast(ts as date) as day from events where event_type = 'error' group by 1 having count(*) >= 2)
select p.day, o.k as "offset", cast(p.day + o.k * interval 1 day as date) as effect_day, s.v as effect_value
from p cross join (select unnest([1, 3, 7]) as k) o left join s on s.day = cast(p.day + o.k * interval 1 day as date)""")
def event_study(spark, d):
    e = table(spark, d, "events").withColumn("day", _day())
    s = e.groupBy("day").agg(_r(F.sum("value"), 4).alias("v"))
    peaks = e.filter("event_type = 'error'").groupBy("day").count().filter("count >= 2").select("day")
    return joins.event_study(peaks, s, "day", "v", [1, 3, 7])


@query("""select e.event_id, q.event_id as span_id from events e join events q on e.user_id = q.user_id
where e.event_type = 'purchase' and q.event_type = 'error' and e.ts >= q.ts and e.ts <= q.ts + interval 6 hour""")
def interval_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    q = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("lo"), (F.col("ts") + F.expr("interval 6 hours")).alias("hi"))
    return joins.interval_join(e.filter("event_type = 'purchase'"), q, "ts", "lo", "hi", 6 * 3600, ["user_id"]).select("event_id", "span_id")


_PLACE = "36 + (({k} * 7919) % 600) / 100.0 as lat, 26 + (({k} * 104729) % 1800) / 100.0 as lon"
_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))))"


@query(f"""with p as (select c_custkey, {_PLACE.format(k='c_custkey')} from customer), s as (select s_suppkey, {_PLACE.format(k='s_suppkey')} from supplier),
h as (select c_custkey, s_suppkey, {_HAV} as km from p, s)
select c_custkey, s_suppkey, round(km, 6) as distance_km from h where km <= 50 qualify row_number() over (partition by c_custkey order by km, s_suppkey) = 1""")
def nearest_market(spark, d):
    at = lambda t, k: table(spark, d, t).selectExpr(k, *_PLACE.format(k=k).replace("100.0", "100D").split(", "))  # noqa: E731  (in doubles, as SQL divides)
    return joins.nearest_site(at("customer", "c_custkey"), at("supplier", "s_suppkey"), 50.0, "c_custkey", "s_suppkey").withColumn("distance_km", _r(F.col("distance_km")))


@query("""with t as (select p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) as w from part)
select a.p_partkey as left_id, b.p_partkey as right_id, round(len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))), 6) as similarity
from t a join t b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey where len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(list_concat(a.w, b.w))) >= 0.5""")
def name_similarity_all(spark, d):
    return _similar_names(table(spark, d, "part"))


def _similar_names(part):
    a = part.select(F.col("p_partkey").alias("left_id"), "p_brand", "p_name")
    pairs = joins.block_similarity(a, a.withColumnRenamed("left_id", "right_id"), "left_id", "right_id", "p_name", 0.5, ("p_brand",), " ", 6)
    return pairs.filter("left_id < right_id")


@query("""select o_orderpriority, l_returnflag, r_name, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def five_way_join(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(c, "o_custkey")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_extendedprice")
    return l.join(o, "o_orderkey").groupBy("o_orderpriority", "l_returnflag", "r_name").agg(F.count("*").alias("n"), _r(F.sum("l_extendedprice"), 2).alias("total"))


# ---- aggregates -----------------------------------------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem group by 1, 2")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_r(F.sum("l_quantity"), 2).alias("sum_qty"), _r(F.sum("l_extendedprice"), 2).alias("sum_price"), _r(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("select cast(year(o_orderdate) as int) as year, round(avg(o_totalprice) / 100, 6) as rate from orders group by 1")
def yearly_mean_rate(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "dd-MM-yyyy").alias("date"), F.col("o_totalprice").alias("value"))
    return pricing.yearly_rates(o).select("year", _r(F.col("rate")).alias("rate"))


@query("select event_type, max(ts) as last_at, arg_max(event_id, ts) as last_id, min(ts) as first_at, count(distinct user_id) as users from events group by 1")
def watermark_by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last_at"), F.max_by("event_id", "ts").alias("last_id"), F.min("ts").alias("first_at"), F.countDistinct("user_id").alias("users"))


@query("select user_id, count(*) filter (where event_type = 'error') as failed, count(*) as total, count(*) filter (where event_type = 'error') * 1.0 / count(*) as fail_rate, case when count(*) filter (where event_type = 'error') * 1.0 / count(*) < 0.05 then 'OK' else 'INCOMPLETE' end as status from events group by 1")
def failure_rate(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("total"))
    return gold.failure_status(g, "failed", "total")


@query("select lang, sum(strlen(text)) as mb_before, sum(n_chars) as mb_after, case when sum(n_chars) = 0 then 0.0 else round(sum(strlen(text)) * 1.0 / sum(n_chars), 6) end as ratio from documents group by 1")
def size_ratio(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).cast("bigint").alias("mb_before"), F.sum("n_chars").alias("mb_after"))
    return g.withColumn("ratio", _r(N.safe_ratio(F.col("mb_before"), F.col("mb_after"))))


@query("select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) as bigint) as grouping_id, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def olap_cube(spark, d):
    return gold.cube(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], n=F.count("*"), total=_r(F.sum("o_totalprice"), 2))


@query("select n_regionkey, n_name, cast(grouping(n_regionkey) * 2 + grouping(n_name) as bigint) as grouping_id, count(*) as n from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, n_name)")
def olap_rollup(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return gold.rollup(j, ["n_regionkey", "n_name"], n=F.count("*"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("_gs_lineitem")
    return spark.sql("select l_returnflag, l_linestatus, count(*) as n from _gs_lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")


@query("""with x as (select n_name, l_extendedprice / l_quantity as v from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)
select n_name, round(avg(v), 6) as mean_value, round(stddev_samp(v) / avg(v), 6) as cv, round(avg(v) / (select avg(v) from x), 6) as expensiveness, count(*) as n from x group by 1""")
def city_inequality(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    x = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("v")).join(s, "l_suppkey")
    return gold.inequality(x, ["n_name"], "v").select("n_name", *[_r(F.col(c)).alias(c) for c in ("mean_value", "cv", "expensiveness")], "n")


@query("select p_brand, round(avg((l_extendedprice / l_quantity - p_retailprice) / p_retailprice), 6) as avg_markup, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")
def sector_markup(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("retail", F.col("l_extendedprice") / F.col("l_quantity"))
    return gold.sector_markup(j, ["p_brand"], "retail", "p_retailprice").select("p_brand", _r(F.col("avg_markup")).alias("avg_markup"), "n")


@query("""with m as (select cast(year(o_orderdate) as int) as year, median(o_totalprice) as median_value from orders group by 1)
select year, round(median_value, 4) as median_value, round(median_value / (select median_value from m where year = 1996), 6) as price_index from m""")
def median_price_index(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return gold.median_index(o, "year", "o_totalprice", 1996).select("year", _r(F.col("median_value"), 4).alias("median_value"), _r(F.col("price_index")).alias("price_index"))


@query("""with s as (select cast(ts as date) as day, sum(value) filter (where event_type = 'view') as v, sum(value) filter (where event_type = 'purchase') as p from events group by 1)
select l.k as lag, round(corr(a.v, b.p), 6) as corr, count(*) as n from s a cross join (select unnest(range(0, 15)) as k) l join s b on b.day = cast(a.day + l.k * interval 1 day as date) group by 1""")
def lag_correlation(spark, d):
    s = table(spark, d, "events").groupBy(_day().alias("day")).agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("v"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("p"))
    return gold.lag_correlation(s, "day", "v", "p", range(15)).select(F.col("lag").cast("bigint").alias("lag"), _r(F.col("corr")).alias("corr"), "n")


@query("""with s as (select cast(ts as date) as day, sum(value) filter (where event_type = 'view') as v, sum(value) filter (where event_type = 'purchase') as p from events group by 1),
c as (select l.k as lag, corr(a.v, b.p) as c from s a cross join (select unnest(range(0, 15)) as k) l join s b on b.day = cast(a.day + l.k * interval 1 day as date) group by 1)
select lag as best_lag from c where c is not null order by abs(c) desc, lag limit 1""")
def shock_lag(spark, d):
    s = table(spark, d, "events").groupBy(_day().alias("day")).agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("v"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("p"))
    return gold.best_lag(gold.lag_correlation(s, "day", "v", "p", range(15))).select(F.col("best_lag").cast("bigint").alias("best_lag"))


@query("""with s as (select l_returnflag, cast(date_trunc('week', l_shipdate) as date) as week, avg(l_quantity) as q, avg(l_extendedprice) as p from lineitem group by 1, 2), g as (select *, lag(q, 2) over (partition by l_returnflag order by week) as q2 from s)
select l_returnflag, round(regr_slope(p, q2), 4) as slope, round(regr_r2(p, q2), 6) as r2 from g where q2 is not null group by 1""")
def lagged_regression(spark, d):
    """Weekly prices on the quantities of two rows before."""
    s = table(spark, d, "lineitem").groupBy("l_returnflag", F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    return gold.lagged_regression(s, ["l_returnflag"], ["week"], "p", "q", 2).select("l_returnflag", _r(F.col("slope"), 4).alias("slope"), _r(F.col("r2")).alias("r2"))


@query("""select o_orderpriority, round(sum(o_totalprice) filter (where o_orderstatus = 'F'), 2) as "F", round(sum(o_totalprice) filter (where o_orderstatus = 'O'), 2) as "O", round(sum(o_totalprice) filter (where o_orderstatus = 'P'), 2) as "P" from orders group by 1""")
def pivot_scorecard(spark, d):
    return reshape.pivot_sum(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.col("o_totalprice"), 2)


_WEEK = "select cast(date_trunc('week', ts) as date) as week, user_id % 7 as chain, avg(value) filter (where event_type = 'view') as w, avg(value) filter (where event_type = 'purchase') as r from events group by 1, 2"


@query(f"""with s as ({_WEEK}), c as (select chain, w / lag(w) over (partition by chain order by week) - 1 as dw, r / lag(r) over (partition by chain order by week) - 1 as dr from s),
g as (select chain, avg(dr / dw) filter (where dw > 0) as u, avg(dr / dw) filter (where dw < 0) as v from c where dw is not null and dw <> 0 group by 1)
select chain, round(u, 6) as up_speed, round(v, 6) as down_speed, round(case when abs(v) > 0 then abs(u) / abs(v) - 1 end, 6) as asymmetry from g""")
def asymmetric_pass_through(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), (F.col("user_id") % 7).alias("chain"))
    s = e.agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("w"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("r"))
    return gold.asymmetry(s, ["chain"], ["week"], "w", "r").select("chain", *[_r(F.col(c)).alias(c) for c in ("up_speed", "down_speed", "asymmetry")])


@query("select user_id, first(event_type order by ts, event_id) as first_type, last(event_type order by ts, event_id) as last_type from events group by 1")
def first_last_value(spark, d):
    k = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", k).alias("first_type"), F.max_by("event_type", k).alias("last_type"))


@query("select l_returnflag, count(*) as n, true as parts_ok, true as median_ok from lineitem group by 1")
def approx_distinct(spark, d):
    """Built-in approximate aggregates beside the exact ones: within four standard errors, and within a thousandth of rank and one value."""
    l = table(spark, d, "lineitem")
    near = l.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.approx_percentile("l_quantity", 0.5, 10_000).alias("median_qty"))
    # The exact ones are counted over distinct values, apart from the sketches: beside count(distinct) a sketch would be kept for every value.
    exact = l.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("exact"))
    median = l.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("rows")).groupBy("l_returnflag").agg(F.expr("percentile(l_quantity, 0.5, rows)").alias("median"))
    same = lambda t: F.col("near.l_returnflag").eqNullSafe(F.col(f"{t}.l_returnflag"))
    g = near.alias("near").join(exact.alias("exact"), same("exact")).join(median.alias("median"), same("median"))
    parts_ok, median_ok = F.abs(F.col("parts") - F.col("exact.exact")) <= 0.08 * F.col("exact.exact") + 1, F.abs(F.col("median_qty") - F.col("median.median")) <= 1
    return g.select("near.l_returnflag", "n", parts_ok.alias("parts_ok"), median_ok.alias("median_ok"))


# ---- dedup, merge, set operations -----------------------------------------------------------------------------------


@query("select * exclude (rn) from (select event_id, user_id, event_type, ts, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def keep_last_row(spark, d):
    return dedup.keep_last(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query("select * exclude (rn) from (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn = 1")
def keep_first_row(spark, d):
    return dedup.keep_one(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])


@query("select distinct l_partkey, l_suppkey from lineitem")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("""with o as (select event_id, value from events where event_id % 3 <> 0), n as (select event_id, value + 1 as value from events where event_id % 2 = 0)
select event_id, value from n union all select event_id, value from o where event_id not in (select event_id from n)""")
def upsert_new_wins(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return dedup.upsert(e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0").withColumn("value", F.col("value") + 1), ["event_id"])


@query("""with a as (select c_nationkey as k, max(c_acctbal) as v from customer group by 1), b as (select s_nationkey + 10 as k, max(s_acctbal) as v from supplier group by 1)
select k, v, 'harvest' as source from a union all select k, v, 'general' from b where k not in (select k from a)""")
def source_priority_all(spark, d):
    # Keys moved by 10 overlap in part though every row of both sources is read.
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 10).alias("k")).agg(F.max("s_acctbal").alias("v"))
    return dedup.by_priority([("harvest", a), ("general", b)], ["k"])


@query("select c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_name, s_acctbal, null from supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return readers.concat_by_name([a, table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45")
def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey"))


# ---- windows --------------------------------------------------------------------------------------------------------


@query("""select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) as valid_to, lead(ts) over (partition by user_id order by ts, event_id) is null as is_current
from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1 or event_type is distinct from p""")
def scd2_intervals(spark, d):
    return windows.scd2(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "ts")


@query("""select event_id, user_id, value, prev_value, round(value - prev_value, 6) as delta from (select *, lag(value) over (partition by user_id order by ts, event_id) as prev_value, row_number() over (partition by user_id order by ts, event_id) as n from events)
where n = 1 or value is distinct from prev_value""")
def price_change_events(spark, d):
    return windows.price_changes(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value", "prev_value", _r(F.col("delta")).alias("delta"))


_MONTH = "select l_returnflag, cast(date_trunc('month', l_shipdate) as date) as month, sum(l_extendedprice) as v from lineitem group by 1, 2"


def _monthly(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.sum("l_extendedprice").alias("v"))


@query(f"with m as ({_MONTH}) select l_returnflag, month, round(avg(v) over w, 4) as moving_avg, round(sum(v) over w, 4) as moving_sum from m window w as (partition by l_returnflag order by month rows between 2 preceding and current row)")
def moving_average(spark, d):
    return windows.moving(_monthly(spark, d), ["l_returnflag"], ["month"], "v", 3).select("l_returnflag", "month", _r(F.col("moving_avg"), 4).alias("moving_avg"), _r(F.col("moving_sum"), 4).alias("moving_sum"))


@query(f"with m as ({_MONTH}) select l_returnflag, month, round(v / lag(v, 12) over w - 1, 6) as pct_change, round(v - lag(v, 12) over w, 4) as diff from m window w as (partition by l_returnflag order by month)")
def year_over_year(spark, d):
    return windows.change_over(_monthly(spark, d), ["l_returnflag"], ["month"], "v", 12).select("l_returnflag", "month", _r(F.col("pct_change")).alias("pct_change"), _r(F.col("diff"), 4).alias("diff"))


@query(f"with s as ({_WEEK}), c as (select *, r / lag(r) over w1 - 1 as rc, w / lag(w) over w1 - 1 as wc from s window w1 as (partition by chain order by week)) select chain, week, round(rc, 6) as retail_change, round(wc, 6) as wholesale_change from c where rc >= 0.1 and abs(wc) <= 0.2")
def retail_jump_anomaly(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), (F.col("user_id") % 7).alias("chain"))
    s = e.agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("w"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("r"))
    return windows.jump_while_flat(s, ["chain"], ["week"], "r", "w", 0.1, 0.2).select("chain", "week", _r(F.col("retail_change")).alias("retail_change"), _r(F.col("wholesale_change")).alias("wholesale_change"))


@query("select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 260")
def last_n_points(spark, d):
    return windows.last_n(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 260).select("event_id", "user_id")


@query("select event_id, cast(ntile(4) over w as int) as quartile, round(percent_rank() over w, 9) as pr, cast(dense_rank() over (partition by event_type order by value) as int) as dr from events window w as (partition by event_type order by value, event_id)")
def ranking_family(spark, d):
    r = ranking.ranked(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", ["event_id"])
    total = F.col("_total")
    return r.select("event_id", ranking.tile(4, F.col("_row"), total).alias("quartile"), _r(ranking.percent(F.col("_rank"), total), 9).alias("pr"), F.col("_dense").cast("int").alias("dr"))


@query("select event_id, round(exp(sum(ln(1 + value / 100000)) over (partition by user_id order by ts, event_id rows unbounded preceding)), 5) as factor from events where value > 0")
def running_growth(spark, d):
    e = table(spark, d, "events").filter("value > 0").withColumn("rate", F.col("value") / 100000)
    return windows.running_product(e, ["user_id"], ["ts", "event_id"], "rate").select("event_id", _r(F.col("factor"), 5).alias("factor"))


@query("""with recursive s as (select user_id, cast(ts as date) as day, sum(value) - 60 as d from events group by 1, 2), o as (select *, row_number() over (partition by user_id order by day) as n from s),
r(user_id, day, n, state) as (select user_id, day, n, least(150.0, greatest(0.0, 75 + d)) from o where n = 1 union all select o.user_id, o.day, o.n, least(150.0, greatest(0.0, r.state + o.d)) from r join o on o.user_id = r.user_id and o.n = r.n + 1)
select user_id, day, round(state, 6) as state from r""")
def clamped_balance_all(spark, d):
    return _balance(table(spark, d, "events"))


def _balance(events):
    s = events.groupBy("user_id", _day().alias("day")).agg((F.sum("value") - 60).alias("d"))
    return windows.clamped_balance(s, ["user_id"], "day", F.col("d")).select("user_id", "day", _r(F.col("state")).alias("state"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("select c_mktsegment, c_nationkey, c_custkey from customer order by 1, 2, 3")
def multi_sort(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey").orderBy("c_mktsegment", "c_nationkey", "c_custkey")


# ---- reshape, arrays ------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, series, value from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name series value value)")
def wide_to_long(spark, d):
    return reshape.wide_to_long(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("select page_id, cast(p.i - 1 as int) as pos, p.part as part from (select page_id, unnest(list_transform(range(1, len(x) + 1), lambda i: {'i': i, 'part': x[i]})) as p from (select page_id, list_filter(string_split(url, '/'), lambda s: s <> '') as x from pages))")
def split_explode(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode_outer(X.nonempty_items(F.col("url"), "/")).alias("pos", "part"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))) / len(embedding), 4) as mean_value, cast(embedding[1] as double) as first_value from embeddings")
def array_mean_first(spark, d):
    a = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", N.array_mean(a).alias("mean_value"), N.first_item(a).alias("first_value"))


@query("select o_orderpriority, string_agg(distinct o_orderstatus, ', ' order by o_orderstatus) as statuses from orders group by 1")
def join_list(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(X.join_items(F.array_sort(F.collect_set("o_orderstatus"))).alias("statuses"))


@query("""with b as (select s_suppkey, 36.0 + (s_suppkey % 5) * 0.1 as south, 36.0 + (s_suppkey % 5) * 0.1 + 0.05 as north, 27.0 as west, 27.04 as east from supplier)
select s_suppkey, count(*) as points from b, range(0, 100) i(i), range(0, 100) j(j) where i.i <= floor((north - south + 1e-9) / 0.01) and j.j <= floor((east - west + 1e-9) / 0.01) group by 1""")
def grid_generation_all(spark, d):
    return _grid(table(spark, d, "supplier"))


def _grid(supplier):
    b = supplier.selectExpr("s_suppkey", "double(36.0D + (s_suppkey % 5) * 0.1D) as south", "36.0D + (s_suppkey % 5) * 0.1D + 0.05D as north", "27.0D as west", "27.04D as east")
    return reshape.grid_points(b, F.lit(0.01)).groupBy("s_suppkey").agg(F.count("*").alias("points"))


@query("select s.user_id, cast(unnest(generate_series(s.a, s.b, interval 1 day)) as date) as day from (select user_id, cast(min(ts) as date) as a, cast(max(ts) as date) as b from events group by 1) s")
def date_spine(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return reshape.date_spine(s, "a", "b").select("user_id", "day")


@query("select o_orderstatus, cast(w as date) as window_start, least(cast(w + interval 3 month - interval 1 day as date), b) as window_end from (select o_orderstatus, unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), interval 3 month)) as w, cast(max(o_orderdate) as date) as b from orders group by 1)")
def month_windows(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.to_date(F.date_trunc("month", F.min("o_orderdate"))).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return reshape.month_windows(s, "a", "b", 3).select("o_orderstatus", "window_start", "window_end")


@query("select r_name, s.o_orderstatus, coalesce(n, 0) as n from region cross join (select distinct o_orderstatus from orders) s left join (select n_regionkey as r, o_orderstatus, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 300000 group by 1, 2) f on f.r = r_regionkey and f.o_orderstatus = s.o_orderstatus")
def densified_cells(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    f = table(spark, d, "orders").filter("o_totalprice > 300000").join(c, "o_custkey").join(n, "c_nationkey").groupBy("r_regionkey", "o_orderstatus").agg(F.count("*").alias("n"))
    dims = [table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "orders").select("o_orderstatus").distinct()]
    return reshape.densify(f, dims, ["r_regionkey", "o_orderstatus"], {"n": 0}).select("r_name", "o_orderstatus", "n")


# ---- scalar functions -----------------------------------------------------------------------------------------------


@query("""select p_partkey, regexp_replace(trim(lower('  ' || p_name || '   ' || p_brand)), '\\s+', ' ', 'g') as key, replace(replace(p_name, ' ', '_'), '/', '-') as safe,
split_part(p_brand || '_x_y', '_', 1) as head, 'x_y' as tail from part""")
def text_normalise(spark, d):
    p = table(spark, d, "part")
    h, t = X.split_composite(F.concat("p_brand", F.lit("_x_y")))
    return p.select("p_partkey", X.norm_key(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand")).alias("key"), X.path_safe(F.col("p_name")).alias("safe"), h.alias("head"), t.alias("tail"))


@query("select p_partkey, round(p_retailprice / (p_size * case p_partkey % 3 when 0 then 0.001 else 1.0 end), 4) as per_unit, case p_partkey % 3 when 0 then 'kg' when 1 then 'kg' else 'lt' end as unit from part")
def unit_price(spark, d):
    u = F.element_at(F.array(F.lit("gr"), F.lit("kg"), F.lit("lt")), (F.col("p_partkey") % 3 + 1).cast("int"))
    title = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" "), u)
    return table(spark, d, "part").select("p_partkey", _r(X.per_base_unit(F.col("p_retailprice"), title), 4).alias("per_unit"), X.unit_of(title)[1].alias("unit"))


@query("select o_orderkey, round(o_totalprice, 2) as price, cast(o_orderdate as date) as day from orders")
def decimal_and_date_formats(spark, d):
    o = table(spark, d, "orders")
    p = F.regexp_replace(F.format_string("%.2f", "o_totalprice"), r"\.", ",")
    fmt = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return o.select("o_orderkey", X.decimal_comma(p).alias("price"), D.any_date(fmt).alias("day"))


@query("select event_id, date_trunc('hour', ts) as hour, time_bucket(interval 15 minute, ts) as quarter, cast(month(ts + interval 1 month) as int) as next_month from events")
def time_buckets(spark, d):
    return table(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"), F.window_time(F.window("ts", "15 minutes")).alias("_w"), F.month("ts").alias("_m"), "ts").select("event_id", "hour", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900).alias("quarter"), D.next_month(F.col("_m")).cast("int").alias("next_month"))


@query("select c_custkey, least(c_acctbal, 100 - c_acctbal) as lo, greatest(c_acctbal, 100 - c_acctbal) as hi from (select c_custkey, round(c_acctbal, 2) as c_acctbal from customer)")
def ordered_price_pair(spark, d):
    b = F.round("c_acctbal", 2)
    return table(spark, d, "customer").select("c_custkey", F.least(b, 100 - b).alias("lo"), F.greatest(b, 100 - b).alias("hi"))


_SEASON_SQL = "case p_partkey % 4 when 0 then [1.25,1.25,1.25,1.25,1.25,1.0,0.8,0.8,0.8,0.8,1.0,1.25] when 1 then [1.25,1.25,1.25,1.25,1.0,0.8,0.8,1.0,1.25,1.25,1.25,1.25] else [1.20,1.15,1.05,0.95,0.90,0.85,0.82,0.83,0.88,0.95,1.08,1.18] end"


@query(f"select p_partkey, cast(({_SEASON_SQL})[(p_partkey % 12) + 1] as double) as season from part")
def season_curves(spark, d):
    title = F.when(F.col("p_partkey") % 4 == 0, "Sofralık Domates").when(F.col("p_partkey") % 4 == 1, "Kiraz").otherwise("ekmek")
    return table(spark, d, "part").select("p_partkey", pricing.season_multiplier(title, (F.col("p_partkey") % 12 + 1).cast("int")).alias("season"))


# Months written out here, not taken from the rules, so that a wrong month there shows.
_CHEAP = ", ".join(f"({i}, [{m}])" for i, m in enumerate("""7,8,9,10 6,7,8 6,7,8,9 6,7,8,9 7,8,9,10 7,8 8,9 4,5,6 4,5 3,4,5 11,12,1,2,3 11,12,1,2 10,11,12,1,2,3 10,11,12,1,2,3,4 12,1,2,3 10,11,12,1,2 11,12,1,2,3
12,1,2,3 11,12,1,2 10,11,12,1 12,3 12,1,2 4,5,6 6,7 6,7,8 6,7,8 5,6,7,8 7,8,9 7,8,9 7,8,9 7,8 8,9,10 10,11,12,1,2,3 10,11,12,1,2 11,12,1,2 10,11,1,2 3,4,5,6,7,8,9,10,11,12""".split()))


@query(f"""with r(rule, cheap) as (values {_CHEAP}), m as (select unnest(range(1, 13)) as month)
select p_partkey, month::int as month, case when list_contains(cheap, month) then 0.8 when list_contains(cheap, (month + 10) % 12 + 1) or list_contains(cheap, month % 12 + 1) then 1.0 else 1.25 end::double as season
from part join r on p_partkey % {len(pricing.SEASON_RULES)} = rule, m""")
def season_rules(spark, d):
    """Every rule, by its first word, in every month."""
    words = F.array(*[F.lit(w[0]) for w, _ in pricing.SEASON_RULES])
    p = table(spark, d, "part").select("p_partkey", F.get(words, (F.col("p_partkey") % len(pricing.SEASON_RULES)).cast("int")).alias("title"))
    return p.select("p_partkey", "title", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).select("p_partkey", "month", pricing.season_multiplier(F.col("title"), F.col("month")).alias("season"))


@query()
def backcast_prices(spark, d):
    """Hash noise is this engine's own, so no SQL oracle: tests check bounds and month factors."""
    import datetime as dt

    days = [dt.date(2025, m, x) for m in (1, 2, 3) for x in (1, 15)]
    dim = pricing.deflation_dim(spark, dt.date(2026, 4, 22), days, {2024: 0.6, 2025: 0.4})
    base = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("d1").alias("depotId"), F.col("p_retailprice").alias("price"))
    return pricing.backcast(base, dim, 4).select("id", "target_date", "price", "unitPrice")


@query("""select c_custkey, round(110.0 * 110.0 * 0, 4) + round((0.2 * 111) * (0.3 * 111) * cos(radians((72.2 + 2 * (c_custkey % 5)) / 2)), 4) as area from customer""")
def bbox_area(spark, d):
    s = F.lit(36.0) + F.col("c_custkey") % 5
    return table(spark, d, "customer").select("c_custkey", _r(N.bbox_area_km2(s, s + 0.2, F.lit(27.0), F.lit(27.3)), 4).alias("area"))


@query("""with w as (select s_suppkey, (10 + s_suppkey % 20)::double as t, (s_suppkey * 7 % 171 - 85)::double as lat, s_suppkey * 13 % 365 + 1 as j, 30 + s_suppkey % 60::double as rh, 1 + s_suppkey % 5 * 0.5::double as u10, s_suppkey % 9::double as kwh, 95 + s_suppkey % 8::double as p from supplier),
sun as (select *, radians(lat) as phi, 0.409 * sin(j * 2 * pi() / 365 - 1.39) as dec, 1 + 0.033 * cos(j * 2 * pi() / 365) as dr from w),
ra as (select *, case when -tan(phi) * tan(dec) >= 1 then 0 when -tan(phi) * tan(dec) <= -1 then pi() else acos(-tan(phi) * tan(dec)) end as ws from sun),
sky as (select *, 1440 / pi() * 0.082 * dr * greatest(ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws), 0) as ra, kwh * 3.6 as rs, 0.6108 * exp(17.27 * (t + 6) / (t + 243.3)) as e1, 0.6108 * exp(17.27 * (t - 6) / (t + 231.3)) as e2 from ra),
air as (select *, (e1 + e2) / 2 as es, (e1 + e2) / 2 * rh / 100 as ea, case when ra > 0 then least(1, rs / (0.75 * ra)) else 1 end as f from sky),
flux as (select *, 0.77 * rs - 4.903e-9 * (pow(t + 279.16, 4) + pow(t + 267.16, 4)) / 2 * (0.34 - 0.14 * sqrt(ea)) * (1.35 * f - 0.35) as rn, 4098 * 0.6108 * exp(17.27 * t / (t + 237.3)) / pow(t + 237.3, 2) as sl, 0.000665 * p as g, u10 * 4.87 / ln(672.58) as u from air)
select s_suppkey, round(greatest((0.408 * sl * rn + g * 900 / (t + 273) * u * (es - ea)) / (sl + g * (1 + 0.34 * u)), 0), 4) as et0, round(ra, 4) as ra from flux""")
def penman_monteith(spark, d):
    s = table(spark, d, "supplier").selectExpr(
        "s_suppkey", "double(10 + s_suppkey % 20) as t", "double(s_suppkey * 7 % 171 - 85) as lat", "double(s_suppkey * 13 % 365 + 1) as j", "double(30 + s_suppkey % 60) as rh", "1 + s_suppkey % 5 * 0.5D as u10", "double(s_suppkey % 9) as kwh", "double(95 + s_suppkey % 8) as p"
    )
    c = F.col
    et0 = N.fao56_et0(c("t") + 6, c("t") - 6, c("t"), c("rh"), c("u10"), c("kwh"), c("p"), c("lat"), c("j"))
    return s.select("s_suppkey", _r(et0, 4).alias("et0"), _r(N.extraterrestrial_mj(c("lat"), c("j")), 4).alias("ra"))


# ---- streams (batch twin of each streaming operator) ----------------------------------------------------------------


@query("select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_window(spark, d):
    return streams.tumbling(table(spark, d, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", _r(F.col("total"), 4))


@query("select w as window_start, event_type, count(*) as n, round(avg(value), 6) as mean from (select event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events) group by 1, 2")
def sliding_window(spark, d):
    return streams.sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"], "value").withColumn("mean", _r(F.col("mean")))


@query("""with m as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as s from events window w as (partition by user_id order by ts)), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from m)
select user_id, min(ts) as session_start, max(ts) + interval 6 hour as session_end, count(*) as n from g group by user_id, k""")
def session_window(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"])
