"""Registered medallion queries (MD-1..6)."""

from __future__ import annotations

from ..sources import adapters as A
from ..sources.tables import Catalog
from . import medallion as M
from .registry import register

_STG_CONTRACTS_SQL = """stg_contracts AS (
  SELECT contract_no AS contract_id, cust_id, CAST(loan_amt AS DECIMAL(18,2)) AS loan_amount,
         CAST(loan_period AS INTEGER) AS loan_period_months, CAST(loan_date AS DATE) AS loan_start_date,
         CASE WHEN status = '01' THEN 'active' WHEN status = '02' THEN 'overdue'
              WHEN status = '03' THEN 'closed' ELSE 'unknown' END AS loan_status
  FROM raw_contracts WHERE loan_amt > 0)"""

_STG_CUSTOMERS_SQL = """stg_customers AS (
  SELECT cust_id, name AS customer_name, CAST(age AS INTEGER) AS age,
         CAST(income AS DECIMAL(18,2)) AS monthly_income, occupation, city_tier, credit_score,
         CASE WHEN gender = '1' THEN 'M' WHEN gender = '2' THEN 'F' ELSE 'U' END AS gender
  FROM raw_customers)"""

_STG_REPAYMENTS_SQL = """stg_repayments AS (
  SELECT contract_no AS contract_id, CAST(period AS INTEGER) AS period_number,
         CAST(due_date AS DATE) AS due_date, CAST(actual_date AS DATE) AS actual_repayment_date,
         CASE WHEN status = '1' THEN 'normal' WHEN status = '2' THEN 'overdue' ELSE 'unknown' END AS repayment_status,
         actual_date IS NOT NULL AS is_paidoff
  FROM raw_repayments)"""

_METRICS_SQL = """repayment_metrics AS (
  SELECT contract_id, count(*) AS total_periods,
         CAST(sum(CASE WHEN repayment_status = 'overdue' THEN 1 ELSE 0 END) AS BIGINT) AS overdue_count,
         max(CASE WHEN repayment_status = 'overdue' THEN 1 ELSE 0 END) AS has_overdue_history
  FROM stg_repayments GROUP BY contract_id)"""

GOLD_SQL = (A.with_ctes("raw_contracts", "raw_customers", "raw_repayments") + ",\n"
            + ",\n".join([_STG_CONTRACTS_SQL, _STG_CUSTOMERS_SQL, _STG_REPAYMENTS_SQL, _METRICS_SQL]) + """
SELECT c.contract_id, c.loan_status, c.loan_amount, c.loan_period_months, c.loan_start_date,
       cust.age, cust.gender, cust.monthly_income, cust.occupation, cust.city_tier, cust.credit_score,
       coalesce(rm.overdue_count, 0) AS overdue_count,
       coalesce(rm.total_periods, 0) AS total_repayment_periods,
       CASE WHEN cust.monthly_income = 0 THEN 'high_risk'
            WHEN CAST(c.loan_amount AS DOUBLE) / CAST(cust.monthly_income AS DOUBLE) > 5 THEN 'high_risk'
            WHEN CAST(c.loan_amount AS DOUBLE) / CAST(cust.monthly_income AS DOUBLE) > 3 THEN 'medium_risk'
            ELSE 'low_risk' END AS dti_category,
       CASE WHEN cust.age < 25 THEN 'young' WHEN cust.age BETWEEN 25 AND 40 THEN 'prime'
            WHEN cust.age BETWEEN 40 AND 55 THEN 'mature' ELSE 'senior' END AS age_group,
       CASE WHEN cust.monthly_income < 5000 THEN 'low_income' WHEN cust.monthly_income < 10000 THEN 'middle_income'
            ELSE 'high_income' END AS income_level,
       CASE WHEN c.loan_period_months > 240 THEN 'ultra_long' WHEN c.loan_period_months > 120 THEN 'long_term'
            ELSE 'short_term' END AS loan_duration_type,
       CASE WHEN coalesce(rm.overdue_count, 0) > 0 THEN 1 ELSE 0 END AS target_label,
       coalesce(rm.has_overdue_history, 0) AS has_overdue_history_flag
FROM stg_contracts c
LEFT JOIN repayment_metrics rm ON c.contract_id = rm.contract_id
LEFT JOIN stg_customers cust ON c.cust_id = cust.cust_id""")


@register("fct_loan_features", GOLD_SQL, "MD-6")
def fct_loan_features(spark, data_dir):
    return M.build_gold(Catalog(spark, data_dir))


@register("stg_contracts", A.with_ctes("raw_contracts") + ",\n" + _STG_CONTRACTS_SQL
          + "\nSELECT * FROM stg_contracts", "MD-2")
def stg_contracts(spark, data_dir):
    return M.stg_contracts(A.raw_contracts(Catalog(spark, data_dir)))


@register("stg_customers", A.with_ctes("raw_customers") + ",\n" + _STG_CUSTOMERS_SQL
          + "\nSELECT * FROM stg_customers", "MD-3")
def stg_customers(spark, data_dir):
    return M.stg_customers(A.raw_customers(Catalog(spark, data_dir)))


@register("stg_repayments", A.with_ctes("raw_repayments") + ",\n" + _STG_REPAYMENTS_SQL
          + "\nSELECT * FROM stg_repayments", "MD-4")
def stg_repayments(spark, data_dir):
    return M.stg_repayments(A.raw_repayments(Catalog(spark, data_dir)))


@register("repayment_metrics", A.with_ctes("raw_repayments") + ",\n" + _STG_REPAYMENTS_SQL + ",\n"
          + _METRICS_SQL + "\nSELECT * FROM repayment_metrics", "MD-5")
def repayment_metrics(spark, data_dir):
    return M.repayment_metrics(M.stg_repayments(A.raw_repayments(Catalog(spark, data_dir))))
