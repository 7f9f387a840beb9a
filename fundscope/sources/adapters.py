"""Map the driver's TPC-H-like tables onto the engine's business tables.

Each adapter is a pure projection (no filter, no sample) of one driver table, so
the adapted table has exactly as many rows as its source and every downstream
query grows with the data.  ``SQL`` holds the same derivations as DuckDB CTE
text for the oracle queries; the two must stay in step.

Money derivations divide by powers of two so they are exact in binary floating
point and round identically in every engine.

Engine tables
-------------
medallion sources : raw_contracts, raw_customers, raw_repayments
audit tables      : persons, employers, deposits, loans, ledger, overdues
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Catalog

# Fixed evaluation date for the audit rules on the driver data (orders run
# 1995-01-01 .. 2001-08-01; events cover January 2024).
AUDIT_AS_OF = "2001-08-01"
LEDGER_AS_OF = "2024-01-31"


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


# ---------------------------------------------------------------- medallion
def raw_contracts(cat: Catalog) -> DataFrame:
    o = cat.orders
    return o.select(
        F.col("o_orderkey").alias("contract_no"),
        F.col("o_custkey").alias("cust_id"),
        F.col("o_totalprice").alias("loan_amt"),
        (F.lit(12) * (F.lit(1) + F.col("o_orderkey") % 30)).cast("int").alias("loan_period"),
        F.col("o_orderdate").alias("loan_date"),
        _case(F.col("o_orderstatus"), {"F": "01", "O": "02", "P": "03"}).alias("status"),
    )


def raw_customers(cat: Catalog) -> DataFrame:
    c = cat.customer
    return c.select(
        F.col("c_custkey").alias("cust_id"),
        F.col("c_name").alias("name"),
        (F.lit(18) + F.col("c_custkey") % 50).cast("int").alias("age"),
        (F.col("c_custkey") % 3).cast("string").alias("gender"),
        F.col("c_acctbal").alias("income"),
        F.col("c_mktsegment").alias("occupation"),
        (F.lit(1) + F.col("c_nationkey") % 3).cast("int").alias("city_tier"),
        (F.lit(300) + (F.col("c_custkey") * 37) % 551).cast("int").alias("credit_score"),
    )


def raw_repayments(cat: Catalog) -> DataFrame:
    li = cat.lineitem
    return li.select(
        F.col("l_orderkey").alias("contract_no"),
        F.col("l_linenumber").alias("period"),
        F.col("l_shipdate").alias("due_date"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("actual_date"),
        F.when(F.col("l_returnflag") == "R", F.lit("2")).otherwise(F.lit("1")).alias("status"),
    )


# ---------------------------------------------------------------- audit
def persons(cat: Catalog) -> DataFrame:
    c = cat.customer
    return c.select(
        F.col("c_custkey").alias("person_id"),
        F.col("c_name").alias("name"),
        F.expr("c_custkey div 15").alias("employer_id"),
        F.concat(F.lit("ID"), F.floor(F.abs(F.col("c_acctbal"))).cast("bigint").cast("string")).alias("id_number"),
        (F.abs(F.col("c_acctbal")) / 8.0).alias("deposit_base"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("frozen")).otherwise(F.lit("normal")).alias("status"),
    )


def employers(cat: Catalog) -> DataFrame:
    e = cat.supplier
    k = F.col("s_suppkey")
    return e.select(
        k.alias("employer_id"),
        F.col("s_name").alias("employer_name"),
        F.col("s_nationkey").alias("employer_type"),
        F.date_add(F.lit("1999-01-01").cast("date"), (k * 37 % 1000).cast("int")).alias("open_date"),
        (F.lit(10) + k % 11).cast("int").alias("headcount"),
    )


def deposits(cat: Catalog) -> DataFrame:
    o = cat.orders
    return o.select(
        F.col("o_orderkey").alias("deposit_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderdate").cast("date").alias("dep_date"),
        (F.col("o_totalprice") / 64.0).alias("amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("makeup deposit"))
         .otherwise(F.lit("regular deposit")).alias("memo"),
    )


def loans(cat: Catalog) -> DataFrame:
    o = cat.orders
    return o.select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_totalprice") * (F.lit(1.0) + (F.col("o_orderkey") % 5) * 0.15)).alias("house_price"),
        F.concat(F.lit("Block "), F.floor(F.col("o_custkey") / 2).cast("bigint").cast("string")).alias("address"),
        _case(F.col("o_orderstatus"), {"F": "disbursed", "O": "pending", "P": "closed"}).alias("status"),
        (F.lit(12) * (F.lit(1) + F.col("o_orderkey") % 30)).cast("int").alias("term_months"),
        F.col("o_orderdate").cast("date").alias("apply_date"),
    )


def ledger(cat: Catalog) -> DataFrame:
    e = cat.events
    return e.select(
        F.col("event_id").alias("ledger_id"),
        F.col("user_id").alias("person_id"),
        F.col("event_type").alias("trans_type"),
        F.col("value").alias("trans_amount"),
        F.col("ts").alias("trans_ts"),
        F.col("event_type").alias("abstract"),
        F.col("props").alias("ext_info"),
    )


def overdues(cat: Catalog) -> DataFrame:
    li = cat.lineitem
    return li.select(
        F.col("l_orderkey").alias("loan_id"),
        F.col("l_linenumber").alias("overdue_seq"),
        (F.col("l_quantity").cast("int") * 7).alias("overdue_days"),
        (F.col("l_extendedprice") / 64.0).alias("overdue_total"),
        F.col("l_returnflag").alias("grade"),
        (F.col("l_linestatus") == "F").alias("settled"),
    )


def knowledge(cat: Catalog) -> DataFrame:
    """Knowledge items (id, category, title = first line, content = whole text,
    tags, created_at) from ``documents``."""
    d = cat.documents
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"),
        F.concat_ws(",", F.col("lang"), F.col("source")).alias("tags"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("created_at"),
    )


ADAPTERS = {
    "knowledge": knowledge,
    "raw_contracts": raw_contracts,
    "raw_customers": raw_customers,
    "raw_repayments": raw_repayments,
    "persons": persons,
    "employers": employers,
    "deposits": deposits,
    "loans": loans,
    "ledger": ledger,
    "overdues": overdues,
}


# DuckDB text of the same derivations, used by the oracle queries.
SQL = {
    "raw_contracts": """raw_contracts AS (
  SELECT o_orderkey AS contract_no, o_custkey AS cust_id, o_totalprice AS loan_amt,
         CAST(12 * (1 + o_orderkey % 30) AS INTEGER) AS loan_period, o_orderdate AS loan_date,
         CASE WHEN o_orderstatus = 'F' THEN '01' WHEN o_orderstatus = 'O' THEN '02'
              WHEN o_orderstatus = 'P' THEN '03' END AS status
  FROM orders)""",
    "raw_customers": """raw_customers AS (
  SELECT c_custkey AS cust_id, c_name AS name, CAST(18 + c_custkey % 50 AS INTEGER) AS age,
         CAST(c_custkey % 3 AS VARCHAR) AS gender, c_acctbal AS income, c_mktsegment AS occupation,
         CAST(1 + c_nationkey % 3 AS INTEGER) AS city_tier,
         CAST(300 + (c_custkey * 37) % 551 AS INTEGER) AS credit_score
  FROM customer)""",
    "raw_repayments": """raw_repayments AS (
  SELECT l_orderkey AS contract_no, l_linenumber AS period, l_shipdate AS due_date,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS actual_date,
         CASE WHEN l_returnflag = 'R' THEN '2' ELSE '1' END AS status
  FROM lineitem)""",
    "persons": """persons AS (
  SELECT c_custkey AS person_id, c_name AS name, c_custkey // 15 AS employer_id,
         'ID' || CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) AS id_number,
         abs(c_acctbal) / 8.0 AS deposit_base, c_acctbal AS balance,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'frozen' ELSE 'normal' END AS status
  FROM customer)""",
    "employers": """employers AS (
  SELECT s_suppkey AS employer_id, s_name AS employer_name, s_nationkey AS employer_type,
         CAST(DATE '1999-01-01' + CAST(s_suppkey * 37 % 1000 AS INTEGER) AS DATE) AS open_date,
         CAST(10 + s_suppkey % 11 AS INTEGER) AS headcount
  FROM supplier)""",
    "deposits": """deposits AS (
  SELECT o_orderkey AS deposit_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS dep_date,
         o_totalprice / 64.0 AS amount,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'makeup deposit' ELSE 'regular deposit' END AS memo
  FROM orders)""",
    "loans": """loans AS (
  SELECT o_orderkey AS loan_id, o_custkey AS person_id, o_totalprice AS amount,
         o_totalprice * (1.0 + (o_orderkey % 5) * 0.15) AS house_price,
         'Block ' || CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS VARCHAR) AS address,
         CASE WHEN o_orderstatus = 'F' THEN 'disbursed' WHEN o_orderstatus = 'O' THEN 'pending'
              WHEN o_orderstatus = 'P' THEN 'closed' END AS status,
         CAST(12 * (1 + o_orderkey % 30) AS INTEGER) AS term_months,
         CAST(o_orderdate AS DATE) AS apply_date
  FROM orders)""",
    "ledger": """ledger AS (
  SELECT event_id AS ledger_id, user_id AS person_id, event_type AS trans_type, value AS trans_amount,
         ts AS trans_ts, event_type AS abstract, props AS ext_info
  FROM events)""",
    "knowledge": """knowledge AS (
  SELECT doc_id AS id, source AS category, split_part(text, chr(10), 1) AS title, text AS content,
         concat_ws(',', lang, source) AS tags, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS created_at
  FROM documents)""",
    "overdues": """overdues AS (
  SELECT l_orderkey AS loan_id, l_linenumber AS overdue_seq, CAST(l_quantity AS INTEGER) * 7 AS overdue_days,
         l_extendedprice / 64.0 AS overdue_total, l_returnflag AS grade, (l_linestatus = 'F') AS settled
  FROM lineitem)""",
}


def with_ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for oracle SQL (caller adds more CTEs)."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
