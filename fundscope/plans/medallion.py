"""Bronze -> silver -> gold models for the loan-default feature table.

Silver models are plain projections, so when they are not materialised
Catalyst fuses them into the gold plan (one scan per source, filters and
column pruning pushed to parquet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import adapters
from ..sources.tables import Catalog


# ------------------------------------------------------------------ bronze
def bronze(cat: Catalog) -> dict[str, DataFrame]:
    """Bronze layer: the raw sources as views (no transformation)."""
    return {
        "contracts": adapters.raw_contracts(cat),
        "customers": adapters.raw_customers(cat),
        "repayments": adapters.raw_repayments(cat),
    }


# ------------------------------------------------------------------ silver
def stg_contracts(raw: DataFrame) -> DataFrame:
    """Rename, cast money to decimal(18,2), map status codes, drop non-positive amounts."""
    return raw.where(F.col("loan_amt") > 0).select(
        F.col("contract_no").alias("contract_id"),
        F.col("cust_id"),
        F.col("loan_amt").cast("decimal(18,2)").alias("loan_amount"),
        F.col("loan_period").cast("int").alias("loan_period_months"),
        F.col("loan_date").cast("date").alias("loan_start_date"),
        F.when(F.col("status") == "01", "active")
         .when(F.col("status") == "02", "overdue")
         .when(F.col("status") == "03", "closed")
         .otherwise("unknown").alias("loan_status"),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("cust_id"),
        F.col("name").alias("customer_name"),
        F.col("age").cast("int").alias("age"),
        F.col("income").cast("decimal(18,2)").alias("monthly_income"),
        F.col("occupation"), F.col("city_tier"), F.col("credit_score"),
        F.when(F.col("gender") == "1", "M").when(F.col("gender") == "2", "F").otherwise("U").alias("gender"),
    )


def stg_repayments(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("contract_no").alias("contract_id"),
        F.col("period").cast("int").alias("period_number"),
        F.col("due_date").cast("date").alias("due_date"),
        F.col("actual_date").cast("date").alias("actual_repayment_date"),
        F.when(F.col("status") == "1", "normal").when(F.col("status") == "2", "overdue")
         .otherwise("unknown").alias("repayment_status"),
        F.col("actual_date").isNotNull().alias("is_paidoff"),
    )


# ------------------------------------------------------------------ gold
def repayment_metrics(repayments: DataFrame) -> DataFrame:
    """Per contract: periods, overdue periods, overdue flag.  Aggregated before
    the join (partial aggregation map-side, one exchange on contract_id)."""
    is_overdue = F.when(F.col("repayment_status") == "overdue", 1).otherwise(0)
    return repayments.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("total_periods"),
        F.sum(is_overdue).alias("overdue_count"),
        F.max(is_overdue).alias("has_overdue_history"),
    )


def dti_category(amount, income):
    """loan/income ratio band; income 0 counts as unbounded ratio (high risk),
    NULL income or amount falls through to low risk."""
    ratio = F.try_divide(amount.cast("double"), income.cast("double"))
    return (F.when(income == 0, "high_risk")
            .when(ratio > 5, "high_risk")
            .when(ratio > 3, "medium_risk")
            .otherwise("low_risk"))


def age_group(age):
    return (F.when(age < 25, "young")
            .when(age.between(25, 40), "prime")
            .when(age.between(40, 55), "mature")
            .otherwise("senior"))


def income_level(income):
    return (F.when(income < 5000, "low_income")
            .when(income < 10000, "middle_income")
            .otherwise("high_income"))


def loan_duration_type(months):
    return (F.when(months > 240, "ultra_long")
            .when(months > 120, "long_term")
            .otherwise("short_term"))


def fct_loan_features(contracts: DataFrame, customers: DataFrame, repayments: DataFrame) -> DataFrame:
    """Gold loan-feature table: contracts left-joined to repayment metrics and customers.

    The metrics join goes first: the aggregate already hash-partitions on
    contract_id, so that join adds only the contracts-side exchange.  The
    customer side is not hinted: AQE broadcasts it when its runtime size is
    under the threshold and otherwise sort-merges, with skew splitting for a
    hot customer.
    """
    m = repayment_metrics(repayments)
    c = contracts.alias("c")
    joined = (c.join(m.alias("rm"), F.col("c.contract_id") == F.col("rm.contract_id"), "left")
               .join(customers.alias("cust"), F.col("c.cust_id") == F.col("cust.cust_id"), "left"))
    overdue = F.coalesce(F.col("rm.overdue_count"), F.lit(0))
    return joined.select(
        F.col("c.contract_id"), F.col("c.loan_status"), F.col("c.loan_amount"),
        F.col("c.loan_period_months"), F.col("c.loan_start_date"),
        F.col("cust.age"), F.col("cust.gender"), F.col("cust.monthly_income"),
        F.col("cust.occupation"), F.col("cust.city_tier"), F.col("cust.credit_score"),
        overdue.alias("overdue_count"),
        F.coalesce(F.col("rm.total_periods"), F.lit(0)).alias("total_repayment_periods"),
        dti_category(F.col("c.loan_amount"), F.col("cust.monthly_income")).alias("dti_category"),
        age_group(F.col("cust.age")).alias("age_group"),
        income_level(F.col("cust.monthly_income")).alias("income_level"),
        loan_duration_type(F.col("c.loan_period_months")).alias("loan_duration_type"),
        F.when(overdue > 0, 1).otherwise(0).alias("target_label"),
        F.coalesce(F.col("rm.has_overdue_history"), F.lit(0)).alias("has_overdue_history_flag"),
    )


def build_gold(cat: Catalog) -> DataFrame:
    b = bronze(cat)
    return fct_loan_features(stg_contracts(b["contracts"]), stg_customers(b["customers"]),
                             stg_repayments(b["repayments"]))


def materialise(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Table materialisation of a layer (silver/gold): write parquet, read back."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)
