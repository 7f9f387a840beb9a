"""Registered data-quality queries (DQ-1..21, MD-7) over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import adapters as A
from ..sources.tables import Catalog
from . import medallion as M
from .q_models import GOLD_SQL
from .registry import register


@register("dq_unique", """
SELECT l_orderkey AS unique_field, count(*) AS n_records FROM lineitem
WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING count(*) > 1""", "DQ-1")
def dq_unique(spark, d):
    return Q.unique(Catalog(spark, d).lineitem, "l_orderkey")


@register("dq_not_null", A.with_ctes("raw_repayments") + """
SELECT * FROM raw_repayments WHERE actual_date IS NULL""", "DQ-2")
def dq_not_null(spark, d):
    return Q.not_null(A.raw_repayments(Catalog(spark, d)), "actual_date")


@register("dq_accepted_values", """
SELECT o_orderpriority AS value_field, count(*) AS n_records FROM orders
WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
GROUP BY o_orderpriority""", "DQ-3")
def dq_accepted_values(spark, d):
    return Q.accepted_values(Catalog(spark, d).orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@register("dq_not_accepted_values", """
SELECT o_orderstatus AS value_field, count(*) AS n_records FROM orders
WHERE o_orderstatus IN ('P') GROUP BY o_orderstatus""", "DQ-12")
def dq_not_accepted_values(spark, d):
    return Q.not_accepted_values(Catalog(spark, d).orders, "o_orderstatus", ["P"])


@register("dq_accepted_range", """
SELECT * FROM lineitem WHERE NOT (l_discount >= 0.0) OR NOT (l_discount <= 0.08)""", "DQ-4")
def dq_accepted_range(spark, d):
    return Q.accepted_range(Catalog(spark, d).lineitem, "l_discount", 0.0, 0.08)


@register("dq_at_least_one", A.with_ctes("raw_repayments") + """
SELECT contract_no, count(actual_date) AS n_values FROM raw_repayments
GROUP BY contract_no HAVING count(actual_date) = 0""", "DQ-5")
def dq_at_least_one(spark, d):
    return Q.at_least_one(A.raw_repayments(Catalog(spark, d)), "actual_date", "contract_no")


@register("dq_cardinality_equality", """
WITH a AS (SELECT o_custkey AS value, count(*) AS num_rows FROM orders GROUP BY 1),
     b AS (SELECT c_custkey AS value, count(*) AS num_rows FROM customer GROUP BY 1)
SELECT *, 'model_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL
SELECT *, 'compare_only' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", "DQ-6")
def dq_cardinality_equality(spark, d):
    cat = Catalog(spark, d)
    return Q.cardinality_equality(cat.orders, "o_custkey", cat.customer, "c_custkey")


_COUNT_JOIN = """
WITH a AS (SELECT o_orderkey AS order_key, count(*) AS count_a FROM orders GROUP BY 1),
     b AS (SELECT l_orderkey AS order_key, count(*) AS count_b FROM lineitem GROUP BY 1),
     j AS (SELECT coalesce(a.order_key, b.order_key) AS order_key, coalesce(count_a, 0) AS count_a,
                  coalesce(count_b, 0) AS count_b
           FROM a FULL JOIN b ON a.order_key IS NOT DISTINCT FROM b.order_key)"""


def _order_key_frames(spark, d):
    cat = Catalog(spark, d)
    return (cat.orders.select(F.col("o_orderkey").alias("order_key")),
            cat.lineitem.select(F.col("l_orderkey").alias("order_key")))


@register("dq_equal_rowcount", _COUNT_JOIN + """
SELECT order_key, count_a, count_b, abs(count_a - count_b) AS diff_count FROM j WHERE count_a <> count_b""",
          "DQ-7/JN-3")
def dq_equal_rowcount(spark, d):
    a, b = _order_key_frames(spark, d)
    return Q.equal_rowcount(a, b, ["order_key"])


@register("dq_fewer_rows_than", _COUNT_JOIN + """
SELECT order_key, count_a, count_b,
       CASE WHEN count_a - count_b = 0 THEN 1 ELSE count_a - count_b END AS row_count_delta
FROM j WHERE count_a >= count_b""", "DQ-8")
def dq_fewer_rows_than(spark, d):
    a, b = _order_key_frames(spark, d)
    return Q.fewer_rows_than(a, b, ["order_key"])


@register("dq_equality", """
SELECT order_key, 'a_minus_b' AS which_diff FROM (SELECT o_orderkey AS order_key FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL
SELECT order_key, 'b_minus_a' AS which_diff FROM (SELECT l_orderkey AS order_key FROM lineitem EXCEPT SELECT o_orderkey FROM orders)
""", "DQ-9/SET-3")
def dq_equality(spark, d):
    cat = Catalog(spark, d)
    return Q.equality(cat.orders.select(F.col("o_orderkey").alias("order_key")),
                      cat.lineitem.select(F.col("l_orderkey").alias("order_key")))


@register("dq_equality_strict", """
SELECT cust_id, 'a_minus_b' AS which_diff FROM (
  SELECT o_custkey AS cust_id FROM orders EXCEPT ALL SELECT c_custkey FROM customer)
UNION ALL
SELECT cust_id, 'b_minus_a' AS which_diff FROM (
  SELECT c_custkey AS cust_id FROM customer EXCEPT ALL SELECT o_custkey FROM orders)""", "DQ-9")
def dq_equality_strict(spark, d):
    cat = Catalog(spark, d)
    return Q.equality(cat.orders.select(F.col("o_custkey").alias("cust_id")),
                      cat.customer.select(F.col("c_custkey").alias("cust_id")), strict=True)


@register("dq_expression_is_true", """
SELECT * FROM lineitem WHERE NOT (l_extendedprice < 90000)""", "DQ-10")
def dq_expression_is_true(spark, d):
    return Q.expression_is_true(Catalog(spark, d).lineitem, "l_extendedprice < 90000")


def _ranges_sql(base_sql, part):
    pb = f"PARTITION BY {part} " if part else ""
    keys = f"{part}, " if part else ""
    return f"""
WITH base AS ({base_sql}),
w AS (SELECT *, lead(lower_bound) OVER ({pb}ORDER BY lower_bound, upper_bound) AS next_lower_bound FROM base),
c AS (SELECT {keys}lower_bound, upper_bound, next_lower_bound,
             lower_bound IS NOT NULL AS lower_bound_not_null, upper_bound IS NOT NULL AS upper_bound_not_null,
             coalesce(lower_bound < upper_bound, false) AS lower_bound_less_than_upper_bound,
             coalesce(coalesce(upper_bound <= next_lower_bound, next_lower_bound IS NULL), false)
               AS upper_bound_ok_with_next_lower_bound
      FROM w)
SELECT * FROM c WHERE NOT (lower_bound_not_null AND upper_bound_not_null AND lower_bound_less_than_upper_bound
                           AND upper_bound_ok_with_next_lower_bound)"""


@register("dq_mutually_exclusive_ranges", _ranges_sql(
    "SELECT o_custkey, CAST(o_orderdate AS DATE) AS lower_bound, CAST(o_orderdate AS DATE) + 180 AS upper_bound "
    "FROM orders", "o_custkey"), "DQ-11/WN-2/WN-3")
def dq_mutually_exclusive_ranges(spark, d):
    o = Catalog(spark, d).orders.select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("lo"),
        F.date_add(F.col("o_orderdate").cast("date"), 180).alias("hi"))
    return Q.mutually_exclusive_ranges(o, "lo", "hi", partition_by=["o_custkey"])


@register("dq_ranges_global", _ranges_sql(
    "SELECT p_partkey * 10 AS lower_bound, p_partkey * 10 + p_size AS upper_bound FROM part", ""), "DQ-11")
def dq_ranges_global(spark, d):
    p = Catalog(spark, d).part.select((F.col("p_partkey") * 10).alias("lo"),
                                      (F.col("p_partkey") * 10 + F.col("p_size")).alias("hi"))
    return Q.mutually_exclusive_ranges(p, "lo", "hi")


@register("dq_not_constant", """
SELECT l_orderkey, count(DISTINCT l_linestatus) AS filler_column FROM lineitem
GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) = 1""", "DQ-13/AG-3")
def dq_not_constant(spark, d):
    return Q.not_constant(Catalog(spark, d).lineitem, "l_linestatus", "l_orderkey")


@register("dq_not_empty_string", """
SELECT page_id, split_part(url, '?', 2) AS query_string FROM pages WHERE trim(split_part(url, '?', 2)) = ''""",
          "DQ-14")
def dq_not_empty_string(spark, d):
    p = Catalog(spark, d).pages.select("page_id", F.split_part("url", F.lit("?"), F.lit(2)).alias("query_string"))
    return Q.not_empty_string(p, "query_string")


@register("dq_not_null_proportion", A.with_ctes("raw_repayments") + """
SELECT contract_no, count(actual_date) / count(*) AS not_null_proportion FROM raw_repayments
GROUP BY contract_no HAVING count(actual_date) / count(*) < 0.6 OR count(actual_date) / count(*) > 1.0""",
          "DQ-15/AG-10")
def dq_not_null_proportion(spark, d):
    return Q.not_null_proportion(A.raw_repayments(Catalog(spark, d)), "actual_date", 0.6, group_by="contract_no")


@register("dq_recency", """
SELECT user_id, max(ts) AS most_recent, TIMESTAMP '2024-01-29 00:00:00' AS threshold FROM events
GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-29 00:00:00'""", "DQ-16")
def dq_recency(spark, d):
    return Q.recency(Catalog(spark, d).events, "ts", "day", 2, "2024-01-31", group_by="user_id")


@register("dq_relationships_where", """
SELECT o.* FROM orders o WHERE o.o_custkey IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'AUTOMOBILE')""",
          "DQ-17/JN-4")
def dq_relationships_where(spark, d):
    cat = Catalog(spark, d)
    return Q.relationships_where(cat.orders, "o_custkey", cat.customer, "c_custkey",
                                 to_condition="c_mktsegment <> 'AUTOMOBILE'")


@register("dq_sequential_values", """
SELECT l_orderkey, l_linenumber, previous_l_linenumber FROM (
  SELECT l_orderkey, l_linenumber,
         lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous_l_linenumber
  FROM lineitem)
WHERE l_linenumber <> previous_l_linenumber + 1""", "DQ-18/WN-4")
def dq_sequential_values(spark, d):
    return Q.sequential_values(Catalog(spark, d).lineitem, "l_linenumber", 1, group_by="l_orderkey")


@register("dq_sequential_global", """
SELECT l_orderkey, previous_l_orderkey FROM (
  SELECT l_orderkey, lag(l_orderkey) OVER (ORDER BY l_orderkey) AS previous_l_orderkey FROM lineitem)
WHERE l_orderkey <> previous_l_orderkey + 1""", "DQ-18")
def dq_sequential_global(spark, d):
    return Q.sequential_values(Catalog(spark, d).lineitem, "l_orderkey", 1)


@register("dq_sequential_dates", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS order_day FROM orders)
SELECT order_day, previous_order_day FROM (
  SELECT order_day, lag(order_day) OVER (ORDER BY order_day) AS previous_order_day FROM d)
WHERE order_day <> previous_order_day + INTERVAL 1 DAY""", "DQ-18")
def dq_sequential_dates(spark, d):
    days = Catalog(spark, d).orders.select(F.col("o_orderdate").cast("date").alias("order_day")).distinct()
    return Q.sequential_values(days, "order_day", 1, datepart="day")


@register("dq_unique_combination", """
SELECT l_orderkey, l_linenumber, count(*) AS n_records FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""", "DQ-19")
def dq_unique_combination(spark, d):
    return Q.unique_combination_of_columns(Catalog(spark, d).lineitem, ["l_orderkey", "l_linenumber"])


@register("dq_assert_equal", A.with_ctes("raw_repayments") + """
SELECT * FROM raw_repayments WHERE actual_date IS DISTINCT FROM due_date""", "DQ-20")
def dq_assert_equal(spark, d):
    return Q.assert_equal(A.raw_repayments(Catalog(spark, d)), "actual_date", "due_date")


@register("dq_suite", "WITH gold AS (" + GOLD_SQL + """),
counts AS (
  SELECT 'unique_contract_id' AS "check", count(*) AS failures, 'error' AS sev FROM (
      SELECT contract_id FROM gold WHERE contract_id IS NOT NULL GROUP BY contract_id HAVING count(*) > 1)
  UNION ALL SELECT 'not_null_contract_id', count(*), 'error' FROM gold WHERE contract_id IS NULL
  UNION ALL SELECT 'not_null_target_label', count(*), 'error' FROM gold WHERE target_label IS NULL
  UNION ALL SELECT 'accepted_values_target_label', count(*), 'error' FROM (
      SELECT target_label FROM gold WHERE target_label IS NOT NULL AND target_label NOT IN (0, 1) GROUP BY 1)
  UNION ALL SELECT 'not_null_loan_amount', count(*), 'error' FROM gold WHERE loan_amount IS NULL
  UNION ALL SELECT 'loan_amount_non_negative', count(*), 'error' FROM gold WHERE NOT (loan_amount >= 0)
  UNION ALL SELECT 'income_present', count(*), 'warn' FROM gold WHERE monthly_income IS NULL
  UNION ALL SELECT 'dti_not_all_high', count(*), 'warn' FROM gold WHERE dti_category = 'high_risk')
SELECT "check", failures,
       CASE WHEN sev = 'error' AND failures <> 0 THEN 'error' WHEN failures <> 0 THEN 'warn' ELSE 'pass' END AS status
FROM counts""", "DQ-21/MD-7")
def dq_suite(spark, d):
    gold = M.build_gold(Catalog(spark, d))
    # row-level checks share one scan of the model; unique / accepted_values group
    checks = [
        Q.Check("unique_contract_id", Q.unique(gold, "contract_id")),
        Q.row_check("not_null_contract_id", gold, F.col("contract_id").isNull()),
        Q.row_check("not_null_target_label", gold, F.col("target_label").isNull()),
        Q.Check("accepted_values_target_label", Q.accepted_values(gold, "target_label", [0, 1])),
        Q.row_check("not_null_loan_amount", gold, F.col("loan_amount").isNull()),
        Q.row_check("loan_amount_non_negative", gold, "NOT (loan_amount >= 0)"),
        Q.row_check("income_present", gold, F.col("monthly_income").isNull(), severity="warn"),
        Q.row_check("dti_not_all_high", gold, "NOT (dti_category <> 'high_risk')", severity="warn"),
    ]
    return Q.run_suite(checks)


@register("dq_row_checks", """
SELECT 'discount_in_range' AS "check", CAST(count_if(coalesce(NOT (l_discount >= 0 AND l_discount <= 0.08), false)) AS BIGINT) AS failures FROM lineitem
UNION ALL SELECT 'quantity_positive', CAST(count_if(coalesce(NOT (l_quantity > 0), false)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'returnflag_not_empty', CAST(count_if(coalesce(trim(l_returnflag) = '', false)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'price_below_90k', CAST(count_if(coalesce(NOT (l_extendedprice < 90000), false)) AS BIGINT) FROM lineitem""",
          "DQ-21")
def dq_row_checks(spark, d):
    li = Catalog(spark, d).lineitem
    return Q.row_checks(li, {
        "discount_in_range": ~((F.col("l_discount") >= 0) & (F.col("l_discount") <= 0.08)),
        "quantity_positive": ~(F.col("l_quantity") > 0),
        "returnflag_not_empty": F.trim("l_returnflag") == "",
        "price_below_90k": "NOT (l_extendedprice < 90000)",
    })
