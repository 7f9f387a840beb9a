"""Registered queries for the table operators (PRJ, RSH, SET, SRT, AG-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as TB
from ..sources.tables import Catalog
from .registry import register


@register("star", """
SELECT o_orderkey AS ord_o_orderkey_x, o_custkey AS ord_o_custkey_x, o_orderstatus AS ord_o_orderstatus_x,
       o_orderdate AS ord_o_orderdate_x
FROM orders""", "PRJ-1")
def q_star(spark, d):
    o = Catalog(spark, d).orders
    return TB.star(o, except_=["O_TOTALPRICE", "o_orderpriority"], prefix="ord_", suffix="_x")


@register("nullcheck", """
SELECT page_id, nullif(split_part(url, '?', 2), '') AS query_string,
       nullif(split_part(url, '#', 2), '') AS fragment, CAST(length(html) AS INTEGER) AS html_len
FROM pages""", "PRJ-3")
def q_nullcheck(spark, d):
    p = Catalog(spark, d).pages
    src = p.select("page_id", F.split_part("url", F.lit("?"), F.lit(2)).alias("query_string"),
                   F.split_part("url", F.lit("#"), F.lit(2)).alias("fragment"),
                   F.length("html").alias("html_len"))
    return TB.nullcheck(src)


@register("dedupe", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_returnflag
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST,
             l_quantity DESC NULLS LAST, l_returnflag DESC NULLS LAST) = 1""", "RSH-3/WN-1")
def q_dedupe(spark, d):
    li = Catalog(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
                                           "l_quantity", "l_returnflag")
    return TB.deduplicate(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@register("pivot_counts", """
SELECT l_returnflag,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS status_O,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS status_F,
       CAST(sum(CASE WHEN l_linestatus = 'X' THEN 1 ELSE 0 END) AS BIGINT) AS status_X
FROM lineitem GROUP BY l_returnflag""", "RSH-4")
def q_pivot_counts(spark, d):
    li = Catalog(spark, d).lineitem
    return TB.pivot(li, "l_returnflag", "l_linestatus", ["O", "F", "X"], prefix="status_")


@register("pivot_amounts", """
SELECT o_orderpriority,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS F_amount,
       round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS O_amount,
       round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS P_amount
FROM orders GROUP BY o_orderpriority""", "RSH-4")
def q_pivot_amounts(spark, d):
    o = Catalog(spark, d).orders
    p = TB.pivot(o, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], then_value=F.col("o_totalprice"),
                 else_value=0.0, suffix="_amount")
    return p.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in ("F_amount", "O_amount", "P_amount")])


_UNPIVOT_SRC = """src AS (
  SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS priority, o_custkey,
         o_totalprice > 200000 AS is_large
  FROM orders)"""


@register("unpivot", "WITH " + _UNPIVOT_SRC + "\n" + "\nUNION ALL\n".join(
    f"SELECT o_orderkey, '{c}' AS field_name, CAST({c} AS VARCHAR) AS value FROM src"
    for c in ("o_orderstatus", "priority", "o_custkey", "is_large")), "RSH-5")
def q_unpivot(spark, d):
    o = Catalog(spark, d).orders
    src = o.select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
                   "o_custkey", (F.col("o_totalprice") > 200000).alias("is_large"))
    return TB.unpivot(src, exclude=["o_orderkey"])


@register("union_relations", """
SELECT 'customer' AS _dbt_source_relation, c_custkey AS id, c_name AS name, c_acctbal AS balance,
       c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation
FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_acctbal, CAST(NULL AS VARCHAR), s_nationkey FROM supplier""", "SET-1/5")
def q_union_relations(spark, d):
    cat = Catalog(spark, d)
    cust = cat.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                               F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    supp = cat.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                               F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return TB.union_relations({"customer": cust, "supplier": supp})


@register("date_spine", """
WITH b AS (SELECT min(date_trunc('month', o_orderdate)) AS s,
                  max(date_trunc('month', o_orderdate)) + INTERVAL 1 MONTH AS e FROM orders),
spine AS (SELECT CAST(unnest(range(s, e, INTERVAL 1 MONTH)) AS DATE) AS date_month FROM b),
m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date_month, count(*) AS n FROM orders GROUP BY 1)
SELECT spine.date_month, coalesce(m.n, 0) AS n_orders FROM spine LEFT JOIN m USING (date_month)""", "RSH-2")
def q_date_spine(spark, d):
    o = Catalog(spark, d).orders
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    bounds = o.agg(F.min(month).alias("s"), F.add_months(F.max(month), 1).alias("e"))
    spine = bounds.select(F.explode(TB.date_spine_col("month", F.col("s"), F.col("e"))).alias("date_month"))
    counts = o.groupBy(month.alias("date_month")).agg(F.count(F.lit(1)).alias("n"))
    return (spine.join(counts, "date_month", "left")
            .select("date_month", F.coalesce(F.col("n"), F.lit(0)).alias("n_orders")))


@register("series", """
WITH s AS (SELECT unnest(generate_series(1, (SELECT max(l_linenumber) FROM lineitem))) AS generated_number),
c AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(generated_number AS INTEGER) AS generated_number, coalesce(c.n, 0) AS n_lines
FROM s LEFT JOIN c ON s.generated_number = c.l_linenumber""", "RSH-1")
def q_series(spark, d):
    li = Catalog(spark, d).lineitem
    s = TB.series(spark, li.agg(F.max("l_linenumber")).first()[0]).withColumn("generated_number", F.col("generated_number").cast("int"))
    c = li.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return (s.join(c, s.generated_number == c.l_linenumber, "left")
            .select("generated_number", F.coalesce(F.col("n"), F.lit(0)).alias("n_lines")))


@register("column_values", """
SELECT o_orderpriority, count(*) AS n_records FROM orders
WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority ORDER BY n_records DESC, o_orderpriority""", "SRT-3")
def q_column_values(spark, d):
    o = Catalog(spark, d).orders
    return TB.column_values(o, "o_orderpriority", where=F.col("o_orderstatus") != "P")


@register("paginate", """
SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows
FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100""", "SRT-2")
def q_paginate(spark, d):
    o = Catalog(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return TB.paginate(o, "o_orderkey", page=3, per_page=50)


@register("sample_rows", """
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3""", "PRJ-7")
def q_sample_rows(spark, d):
    o = Catalog(spark, d).orders.select("o_orderkey", "o_orderstatus")
    return TB.sample_rows(o.orderBy("o_orderkey"), 3)


@register("rename_columns", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice, o_orderdate,
       o_orderpriority FROM orders""", "SRC-8")
def q_rename_columns(spark, d):
    o = Catalog(spark, d).orders
    return TB.rename_by_mapping(o, {"order_id": ["O-ORDERKEY"], "customer_id": ["o cust key"],
                                    "status": ["Order Status", "o_orderstatus"]})


@register("group_by_n", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n_lines
FROM lineitem GROUP BY 1, 2""", "AG-9")
def q_group_by_n(spark, d):
    li = Catalog(spark, d).lineitem.select("l_returnflag", "l_linestatus", "l_quantity")
    return TB.group_by_n(li, 2, F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
                         F.count(F.lit(1)).alias("n_lines"))


@register("paginate_deep", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, (SELECT count(*) FROM lineitem) AS total_rows
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 40 OFFSET (SELECT count(*) // 80 * 40 FROM lineitem)""", "SRT-2")
def q_paginate_deep(spark, d):
    """The page in the middle of the table."""
    rows = Catalog(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    directory = TB.PageDirectory.build(rows, rows.columns)
    return directory.page(rows, directory.total_rows // 80 + 1, 40)
