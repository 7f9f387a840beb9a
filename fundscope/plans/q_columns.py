"""Registered queries for the column functions (SC-*, PRJ-6) over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import tables as TB
from ..sources.tables import Catalog
from .registry import register


@register("safe_divide", """
SELECT l_orderkey, l_linenumber,
       l_extendedprice / nullif(l_discount, 0) AS price_per_discount,
       coalesce(l_tax / nullif(l_discount, 0), 0) AS tax_per_discount
FROM lineitem""", "SC-3/4")
def q_safe_divide(spark, d):
    li = Catalog(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     C.safe_divide("l_extendedprice", "l_discount").alias("price_per_discount"),
                     C.safe_divide("l_tax", "l_discount", default=0.0).alias("tax_per_discount"))


@register("safe_add", """
SELECT l_orderkey, l_linenumber,
       coalesce(l_quantity, 0) + coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0) AS safe_sum,
       coalesce(l_quantity, 0) - coalesce(nullif(l_discount, 0), 0) - coalesce(nullif(l_tax, 0), 0) AS safe_diff
FROM lineitem""", "SC-1/2")
def q_safe_add(spark, d):
    li = Catalog(spark, d).lineitem
    disc = F.nullif(F.col("l_discount"), F.lit(0.0))
    tax = F.nullif(F.col("l_tax"), F.lit(0.0))
    return li.select("l_orderkey", "l_linenumber",
                     C.safe_add("l_quantity", disc, tax).alias("safe_sum"),
                     C.safe_subtract("l_quantity", disc, tax).alias("safe_diff"))


@register("surrogate_key", """
SELECT o_orderkey,
       md5(concat_ws('-', coalesce(CAST(o_custkey AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                          coalesce(CAST(o_orderstatus AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                          coalesce(CAST(nullif(o_orderpriority, '5-LOW') AS VARCHAR), '_dbt_utils_surrogate_key_null_')))
         AS order_sk,
       md5(concat_ws('-', coalesce(CAST(o_orderkey AS VARCHAR), ''),
                          coalesce(CAST(nullif(o_orderpriority, '5-LOW') AS VARCHAR), ''))) AS order_sk_empty_nulls
FROM orders""", "SC-5")
def q_surrogate_key(spark, d):
    o = Catalog(spark, d).orders
    pr = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return o.select("o_orderkey",
                    C.surrogate_key("o_custkey", "o_orderstatus", pr).alias("order_sk"),
                    C.surrogate_key("o_orderkey", pr, null_as_empty=True).alias("order_sk_empty_nulls"))


_HAV = """2 * 3961 * asin(sqrt(least(1.0,
            pow(sin((radians(lat2) - radians(lat1)) / 2), 2)
          + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))"""


@register("haversine", f"""
WITH p AS (
  SELECT c_custkey, c_acctbal / 111.0 AS lat1, (c_custkey % 360) - 180 AS lon1,
         n_nationkey * 7 - 80 AS lat2, n_nationkey * 14 - 170 AS lon2
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, round({_HAV}, 4) AS distance_mi, round({_HAV} * 1.60934, 4) AS distance_km FROM p""",
          "SC-6")
def q_haversine(spark, d):
    cat = Catalog(spark, d)
    # nation is a fixed 25-row dimension: a bounded broadcast
    p = cat.customer.join(F.broadcast(cat.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", (F.col("c_acctbal") / 111.0).alias("lat1"), ((F.col("c_custkey") % 360) - 180).alias("lon1"),
        (F.col("n_nationkey") * 7 - 80).alias("lat2"), (F.col("n_nationkey") * 14 - 170).alias("lon2"))
    return p.select("c_custkey",
                    F.round(C.haversine("lat1", "lon1", "lat2", "lon2"), 4).alias("distance_mi"),
                    F.round(C.haversine("lat1", "lon1", "lat2", "lon2", unit="km"), 4).alias("distance_km"))


@register("width_bucket", """
SELECT o_orderkey,
       CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 400000 THEN 11
            ELSE CAST(floor(10 * (o_totalprice - 0) / (400000 - 0)) AS BIGINT) + 1 END AS price_bucket
FROM orders""", "SC-7")
def q_width_bucket(spark, d):
    o = Catalog(spark, d).orders
    return o.select("o_orderkey", C.width_bucket("o_totalprice", 0, 400000, 10).alias("price_bucket"))


_STRIP_HOST = "replace(replace(replace(url, 'android-app://', ''), 'http://', ''), 'https://', '')"
_STRIP_PATH = "replace(replace(url, 'http://', ''), 'https://', '')"


@register("url_parts", f"""
SELECT page_id,
       split_part(split_part({_STRIP_HOST}, '/', 1), '?', 1) AS url_host,
       split_part(right({_STRIP_PATH}, length({_STRIP_PATH})
             - coalesce(nullif(strpos({_STRIP_PATH}, '/'), 0), strpos({_STRIP_PATH}, '?') - 1)), '?', 1) AS url_path,
       nullif(split_part(split_part(url, 'utm_source=', 2), '&', 1), '') AS utm_source,
       nullif(split_part(split_part(url, 'page=', 2), '&', 1), '') AS page_param
FROM pages""", "SC-8/9/10")
def q_url_parts(spark, d):
    p = Catalog(spark, d).pages
    return p.select("page_id", C.url_host("url").alias("url_host"), C.url_path("url").alias("url_path"),
                    C.url_parameter("url", "utm_source").alias("utm_source"),
                    C.url_parameter("url", "page").alias("page_param"))


def _slug_sql(x):
    s = f"regexp_replace(regexp_replace(lower({x}), '[ -]+', '_', 'g'), '[^a-z0-9_]+', '', 'g')"
    return f"CASE WHEN regexp_matches({s}, '^[0-9]') THEN '_' || {s} ELSE {s} END"


@register("slugify", f"""
SELECT p_partkey, {_slug_sql('p_type')} AS type_slug, {_slug_sql('p_name')} AS name_slug,
       {_slug_sql("CAST(p_size AS VARCHAR) || ' ' || p_brand")} AS size_brand_slug
FROM part""", "SC-19")
def q_slugify(spark, d):
    p = Catalog(spark, d).part
    return p.select("p_partkey", C.slugify("p_type").alias("type_slug"), C.slugify("p_name").alias("name_slug"),
                    C.slugify(F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand")))
                    .alias("size_brand_slug"))


def _mask_id_sql(v):
    return (f"CASE WHEN regexp_matches({v}, '^\\d{{17}}[\\dXx]$') "
            f"THEN left({v}, 6) || '********' || right({v}, 4) ELSE {v} END")


@register("mask_pii", f"""
WITH src AS (
  SELECT c_custkey, c_name AS name,
         '110101' || lpad(CAST(c_custkey AS VARCHAR), 11, '0') || CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE '7' END
           AS id_number,
         c_mktsegment
  FROM customer)
SELECT c_custkey,
       CASE WHEN regexp_matches(name, '^\\d{{17}}[\\dXx]$') THEN {_mask_id_sql('name')}
            WHEN length(name) >= 2 THEN left(name, 1) || repeat('*', length(name) - 1) ELSE name END AS name,
       {_mask_id_sql('id_number')} AS id_number,
       {_mask_id_sql('c_mktsegment')} AS c_mktsegment
FROM src""", "PRJ-6")
def q_mask_pii(spark, d):
    c = Catalog(spark, d).customer
    src = c.select("c_custkey", F.col("c_name").alias("name"),
                   F.concat(F.lit("110101"), F.lpad(F.col("c_custkey").cast("string"), 11, "0"),
                            F.when(F.col("c_custkey") % 2 == 0, F.lit("X")).otherwise(F.lit("7"))).alias("id_number"),
                   "c_mktsegment")
    return TB.mask_pii(src)


@register("date_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(ts) AS INTEGER) AS weekday_sun0, strftime(ts, '%Y-%m') AS year_month,
       CAST(CAST(ts AS DATE) - INTERVAL 6 MONTH AS DATE) AS six_months_before,
       CAST(CAST(ts AS DATE) - INTERVAL 1 YEAR AS DATE) AS one_year_before,
       round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 86400e6, 6) AS days_since_start,
       CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS whole_days_since_start
FROM events""", "SC-13/14/15")
def q_date_parts(spark, d):
    e = Catalog(spark, d).events
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return e.select("event_id", F.hour("ts").alias("hour_of_day"), C.weekday_sun0("ts").alias("weekday_sun0"),
                    C.year_month("ts").alias("year_month"),
                    F.add_months(F.col("ts").cast("date"), -6).alias("six_months_before"),
                    F.add_months(F.col("ts").cast("date"), -12).alias("one_year_before"),
                    F.round(C.fractional_days_between("ts", start), 6).alias("days_since_start"),
                    F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("whole_days_since_start"))
