"""Registered statistics queries (ANA-1..4, AG-6/7/8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as SK
from ..operators import stats as ST
from ..session import written_table_dir
from ..sources.tables import Catalog
from .registry import register

_SUMMARY = """SELECT {by}count(x) AS count, round(sum(x), 4) AS sum, round(avg(x), 4) AS mean, min(x) AS min,
       max(x) AS max, max(x) - min(x) AS range, round(stddev_pop(x), 4) AS std_dev, median(x) AS median
FROM (SELECT {by}{field} AS x FROM {table}) {group}"""


def _round_summary(df):
    return df.select(*[F.round(c, 4).alias(c) if c in ("sum", "mean", "std_dev") else F.col(c) for c in df.columns])


@register("stats_summary", _SUMMARY.format(by="", field="l_extendedprice", table="lineitem", group=""), "ANA-1")
def stats_summary(spark, d):
    return _round_summary(ST.summary(Catalog(spark, d).lineitem, "l_extendedprice"))


@register("stats_summary_grouped", _SUMMARY.format(by="l_returnflag, ", field="o_totalprice",
                                                   table="orders JOIN lineitem ON o_orderkey = l_orderkey",
                                                   group="GROUP BY l_returnflag"), "ANA-1/AG-6/AG-7")
def stats_summary_grouped(spark, d):
    cat = Catalog(spark, d)
    o, li = cat.orders, cat.lineitem
    j = o.join(li, o.o_orderkey == li.l_orderkey).select(
        "l_returnflag", "o_totalprice")
    return _round_summary(ST.summary(j, "o_totalprice", by="l_returnflag"))


@register("stats_trend", """
WITH r AS (SELECT o_orderpriority, o_totalprice AS x,
                  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
                  count(*) OVER (PARTITION BY o_orderpriority) AS n
           FROM orders),
h AS (SELECT o_orderpriority, avg(CASE WHEN pos < n // 2 THEN x END) AS a1, avg(CASE WHEN pos >= n // 2 THEN x END) AS a2
      FROM r WHERE n >= 3 GROUP BY o_orderpriority)
SELECT o_orderpriority, round(a1, 2) AS first_half_avg, round(a2, 2) AS second_half_avg, round(a2 - a1, 2) AS change,
       round(CASE WHEN a1 <> 0 THEN (a2 - a1) / a1 * 100 ELSE 0.0 END, 2) AS change_percent,
       CASE WHEN a2 - a1 > 0 THEN 'up' WHEN a2 - a1 < 0 THEN 'down' ELSE 'flat' END AS trend
FROM h""", "ANA-2/WN-7")
def stats_trend(spark, d):
    o = Catalog(spark, d).orders
    return ST.trend(o, "o_totalprice", ["o_orderdate", "o_orderkey"], by="o_orderpriority")


@register("stats_trend_global", """
WITH r AS (SELECT value AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
h AS (SELECT avg(CASE WHEN pos < n // 2 THEN x END) AS a1, avg(CASE WHEN pos >= n // 2 THEN x END) AS a2
      FROM r WHERE n >= 3)
SELECT round(a1, 2) AS first_half_avg, round(a2, 2) AS second_half_avg, round(a2 - a1, 2) AS change,
       round(CASE WHEN a1 <> 0 THEN (a2 - a1) / a1 * 100 ELSE 0.0 END, 2) AS change_percent,
       CASE WHEN a2 - a1 > 0 THEN 'up' WHEN a2 - a1 < 0 THEN 'down' ELSE 'flat' END AS trend
FROM h WHERE (SELECT count(*) FROM events) >= 3""", "ANA-2")
def stats_trend_global(spark, d):
    e = Catalog(spark, d).events
    return ST.trend(e, "value", ["ts", "event_id"])


@register("stats_zscore", """
WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
SELECT li.*, round(abs((l_extendedprice - m) / sd), 2) AS z_score, round(l_extendedprice - m, 2) AS deviation
FROM lineitem li JOIN s USING (l_returnflag)
WHERE sd > 0 AND l_extendedprice IS NOT NULL AND abs((l_extendedprice - m) / sd) > 1.5""", "ANA-3")
def stats_zscore(spark, d):
    return ST.zscore(Catalog(spark, d).lineitem, "l_extendedprice", 1.5, by="l_returnflag")


# keys with missing values: NULL is a group like any other
_GAPS = "(SELECT CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status, o_orderkey, o_orderdate, o_totalprice FROM orders)"


def _gaps(spark, d):
    return Catalog(spark, d).orders.selectExpr("CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status", "o_orderkey",
                                               "o_orderdate", "o_totalprice")


@register("stats_summary_null_group", _SUMMARY.format(by="status, ", field="o_totalprice", table=_GAPS, group="GROUP BY status"),
          "ANA-1/AG-6")
def stats_summary_null_group(spark, d):
    return _round_summary(ST.summary(_gaps(spark, d), "o_totalprice", by="status"))


@register("stats_trend_null_group", f"""
WITH r AS (SELECT status, o_totalprice AS x, row_number() OVER (PARTITION BY status ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
                  count(*) OVER (PARTITION BY status) AS n FROM {_GAPS}),
h AS (SELECT status, avg(CASE WHEN pos < n // 2 THEN x END) AS a1, avg(CASE WHEN pos >= n // 2 THEN x END) AS a2
      FROM r WHERE n >= 3 GROUP BY status)
SELECT status, round(a1, 2) AS first_half_avg, round(a2, 2) AS second_half_avg, round(a2 - a1, 2) AS change,
       round(CASE WHEN a1 <> 0 THEN (a2 - a1) / a1 * 100 ELSE 0.0 END, 2) AS change_percent,
       CASE WHEN a2 - a1 > 0 THEN 'up' WHEN a2 - a1 < 0 THEN 'down' ELSE 'flat' END AS trend
FROM h""", "ANA-2/WN-7")
def stats_trend_null_group(spark, d):
    return ST.trend(_gaps(spark, d), "o_totalprice", ["o_orderdate", "o_orderkey"], by="status")


@register("stats_zscore_null_group", f"""
WITH s AS (SELECT status, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM {_GAPS} GROUP BY 1)
SELECT o.*, round(abs((o_totalprice - m) / sd), 2) AS z_score, round(o_totalprice - m, 2) AS deviation
FROM {_GAPS} o JOIN s ON o.status IS NOT DISTINCT FROM s.status
WHERE sd > 0 AND abs((o_totalprice - m) / sd) > 1.5""", "ANA-3")
def stats_zscore_null_group(spark, d):
    return ST.zscore(_gaps(spark, d), "o_totalprice", 1.5, by="status")


@register("stats_zscore_global", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders)
SELECT o.*, round(abs((o_totalprice - m) / sd), 2) AS z_score, round(o_totalprice - m, 2) AS deviation
FROM orders o, s WHERE sd > 0 AND o_totalprice IS NOT NULL AND abs((o_totalprice - m) / sd) > 1.5""", "ANA-3")
def stats_zscore_global(spark, d):
    return ST.zscore(Catalog(spark, d).orders, "o_totalprice", 1.5)


@register("stats_distribution", """
WITH c AS (SELECT l_quantity AS value, count(*) AS count FROM lineitem GROUP BY 1),
t AS (SELECT sum(count) AS total_count, count(*) AS unique_values FROM c)
SELECT value, count, round(count * 100.0 / total_count, 1) AS percentage, CAST(total_count AS BIGINT) AS total_count,
       unique_values
FROM c, t ORDER BY count DESC, value LIMIT 20""", "ANA-4/AG-8")
def stats_distribution(spark, d):
    return ST.distribution(Catalog(spark, d).lineitem, "l_quantity", top=20)


# sketches are estimates: that they keep their bounds against the exact answers is what SQL can state
@register("ana_sketches", """
SELECT event_type, count(*) AS n, true AS distinct_within_bound, true AS median_within_bound FROM events GROUP BY event_type""", "ANA-1/AG-3/AG-6")
def ana_sketches(spark, d):
    """Ids and values of each event type from stored daily sketches, held against the exact count and the rank of the median."""
    e, path = Catalog(spark, d).events, written_table_dir(spark, "sketches")
    SK.sketch_days(e, ["event_type"], F.to_date("ts"), "event_id", "value").write.parquet(path)
    found = SK.estimates(SK.merged(spark.read.parquet(path), ["event_type"]))
    exact = (e.join(F.broadcast(found.select(F.col("event_type").alias("_t"), "q50")), F.col("event_type") == F.col("_t"))  # one row a type
             .groupBy("event_type").agg(F.count_distinct("event_id").alias("ids"), F.count("value").alias("values"), F.count_if(F.col("value") <= F.col("q50")).alias("below")))
    near = F.abs(F.col("distinct_ids") - F.col("ids")) <= F.col("ids") * SK.DISTINCT_BOUND + 1
    ranked = F.abs(F.col("below") - F.col("values") / 2) <= F.col("values") * SK.RANK_BOUND + 1
    return found.join(exact, "event_type").select("event_type", "n", near.alias("distinct_within_bound"), ranked.alias("median_within_bound"))
