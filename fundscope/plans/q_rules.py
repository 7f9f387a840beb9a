"""Registered audit-rule queries (AU-1..20) over the adapted driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources.adapters import AUDIT_AS_OF, LEDGER_AS_OF
from ..sources.tables import Catalog
from . import rules as R
from .registry import register

ALL = A.with_ctes("persons", "employers", "deposits", "loans", "ledger", "overdues")
DEP = "dep AS (SELECT * FROM deposits WHERE memo ILIKE '%regular%' OR memo ILIKE '%makeup%')"

# Parameters of the registered rule queries on the driver data (the ledger
# covers one month, so its windows are in days; orders cover 1995-2001).
P = {
    "frequent_withdrawals": dict(trans_type="purchase", months=6, min_count=14, high_count=17),
    "remote_withdrawals": dict(text_like="%sign%", json_path="$.k", years=1),
    "withdrawal_near_balance": dict(trans_type="view", months=3, max_ratio=80.0),
    "loan_to_value": dict(max_ratio=80.0),
    "debt_to_income": dict(threshold=100.0),
    "high_base_before_application": dict(months=6, min_base=1000.0),
    "dormant_reactivated": dict(dormant_days=1.0, min_amount=20.0),
    "employer_arrears": dict(periods=6, min_missing=3),
    "employer_arrears_consecutive": dict(periods=6, min_missing=2, consecutive=True),
    "pre_loan_surge": dict(min_increase=0.5),
    "makeup_arbitrage": dict(multiple=6.0),
    "post_loan_arrears": dict(min_ratio=20.0),
    "overdue_listing": dict(min_days=200),
}


def _t(spark, d) -> R.AuditTables:
    return R.AuditTables.from_catalog(Catalog(spark, d))


def _sql(body: str, *extra_ctes: str) -> str:
    return ALL + "".join(",\n" + c for c in extra_ctes) + "\n" + body


S = {}

p = P["frequent_withdrawals"]
S["frequent_withdrawals"] = _sql(f"""
SELECT a.person_id, p.name, a.times, round(a.total_amount, 2) AS total_amount, a.first_ts, a.last_ts,
       CASE WHEN a.times >= {p['high_count']} THEN 'high' ELSE 'medium' END AS risk_level
FROM agg a JOIN persons p USING (person_id)""", f"""agg AS (
  SELECT person_id, count(*) AS times, sum(trans_amount) AS total_amount, min(trans_ts) AS first_ts,
         max(trans_ts) AS last_ts
  FROM ledger WHERE trans_type = '{p['trans_type']}'
    AND trans_ts >= CAST(DATE '{LEDGER_AS_OF}' - INTERVAL {p['months']} MONTH AS TIMESTAMP)
  GROUP BY person_id HAVING count(*) >= {p['min_count']})""")

p = P["remote_withdrawals"]
S["remote_withdrawals"] = _sql(f"""
SELECT j.ledger_id, j.person_id, p.name, json_extract_string(j.ext_info, '{p['json_path']}') AS withdraw_location,
       j.trans_amount, j.trans_ts
FROM ledger j JOIN persons p USING (person_id)
WHERE j.trans_ts >= CAST(DATE '{LEDGER_AS_OF}' - INTERVAL {12 * p['years']} MONTH AS TIMESTAMP)
  AND j.abstract ILIKE '{p['text_like']}'""")

p = P["withdrawal_near_balance"]
S["withdrawal_near_balance"] = _sql(f"""
SELECT * FROM (
  SELECT j.ledger_id, j.person_id, p.name, j.trans_amount, p.balance,
         round(j.trans_amount * 100.0 / nullif(p.balance, 0), 2) AS ratio
  FROM ledger j JOIN persons p USING (person_id)
  WHERE j.trans_type = '{p['trans_type']}'
    AND j.trans_ts >= CAST(DATE '{LEDGER_AS_OF}' - INTERVAL {p['months']} MONTH AS TIMESTAMP))
WHERE ratio > {p['max_ratio']}""")

S["loan_to_value"] = _sql("""
SELECT loan_id, person_id, amount, house_price, loan_ratio, round(100.0 - loan_ratio, 2) AS down_payment_ratio,
       CASE WHEN round(100.0 - loan_ratio, 2) < 20 THEN 'high' WHEN round(100.0 - loan_ratio, 2) < 30 THEN 'medium'
            ELSE 'low' END AS risk_level
FROM (SELECT loan_id, person_id, amount, house_price, round(amount * 100.0 / nullif(house_price, 0), 2) AS loan_ratio
      FROM loans WHERE status IN ('pending', 'disbursed'))
WHERE loan_ratio > 80.0""")

S["debt_to_income"] = _sql(f"""
SELECT * FROM (
  SELECT l.loan_id, l.person_id, p.name, l.amount, p.deposit_base,
         round(l.amount / nullif(p.deposit_base * 12, 0), 2) AS estimated_dti
  FROM loans l JOIN persons p USING (person_id) WHERE l.status IN ('pending', 'disbursed'))
WHERE estimated_dti > {P['debt_to_income']['threshold']}""")

S["duplicate_collateral"] = _sql("""
SELECT address, loan_id, person_id, amount, loan_count, round(total_amount, 2) AS total_amount, statuses
FROM l JOIN pa USING (address)""",
                                 "l AS (SELECT * FROM loans WHERE status IN ('pending', 'disbursed') "
                                 "AND address IS NOT NULL)",
                                 "pa AS (SELECT address, count(*) AS loan_count, sum(amount) AS total_amount, "
                                 "string_agg(DISTINCT status, ',' ORDER BY status) AS statuses "
                                 "FROM l GROUP BY address HAVING count(*) > 1)")

p = P["high_base_before_application"]
S["high_base_before_application"] = _sql(f"""
SELECT l.loan_id, l.person_id, p.name, p.deposit_base, l.amount, l.apply_date
FROM loans l JOIN persons p USING (person_id)
WHERE l.apply_date >= DATE '{AUDIT_AS_OF}' - INTERVAL {p['months']} MONTH AND p.deposit_base > {p['min_base']}""")

p = P["dormant_reactivated"]
S["dormant_reactivated"] = _sql(f"""
SELECT g.*, p.name FROM g LEFT JOIN persons p USING (person_id)
WHERE dormant_days > {p['dormant_days']} AND trans_amount > {p['min_amount']}""",
                                """b AS (SELECT ledger_id, person_id, trans_ts, trans_amount,
         lag(trans_ts) OVER (PARTITION BY person_id ORDER BY trans_ts, ledger_id, trans_amount) AS last_trans_ts
  FROM ledger)""", """g AS (SELECT ledger_id, person_id, trans_ts, last_trans_ts,
         round((epoch_us(trans_ts) - epoch_us(last_trans_ts)) / 86400e6, 6) AS dormant_days, trans_amount FROM b)""")

_OFF = """SELECT ledger_id, person_id, trans_type, trans_amount, trans_ts, CAST(hour(trans_ts) AS INTEGER) AS hour,
       CAST(dayofweek(trans_ts) AS INTEGER) AS weekday,
       (hour(trans_ts) < 8 OR hour(trans_ts) > 22) AS is_night, dayofweek(trans_ts) IN (0, 6) AS is_weekend
FROM ledger WHERE (hour(trans_ts) < 8 OR hour(trans_ts) > 22) OR dayofweek(trans_ts) IN (0, 6)"""
S["off_hours_operations"] = _sql(_OFF)
S["off_hours_summary"] = _sql("""
SELECT person_id, CAST(count_if(is_night) AS BIGINT) AS night_count,
       CAST(count_if(is_weekend) AS BIGINT) AS weekend_count,
       count(*) AS off_hours_count
FROM o GROUP BY person_id""", "o AS (" + _OFF + ")")


def _arrears_sql(p):
    n = p["periods"]
    first = f"CAST(DATE '{AUDIT_AS_OF}' - INTERVAL {n - 1} MONTH AS DATE)"
    grid = (f"grid AS (SELECT employer_id, employer_name, k, "
            f"CAST(date_trunc('month', DATE '{AUDIT_AS_OF}') - k * INTERVAL 1 MONTH AS DATE) AS period_start "
            f"FROM employers, (SELECT CAST(range AS INTEGER) AS k FROM range({n})))")
    active = (f"active AS (SELECT DISTINCT p.employer_id, CAST(date_trunc('month', d.dep_date) AS DATE) AS period_start "
              f"FROM dep d JOIN persons p USING (person_id) "
              f"WHERE d.dep_date >= date_trunc('month', {first}) AND d.dep_date <= DATE '{AUDIT_AS_OF}')")
    missing = ("missing AS (SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM active a "
               "WHERE a.employer_id = g.employer_id AND a.period_start = g.period_start))")
    if p.get("consecutive"):
        body = f"""
SELECT employer_id, employer_name, max(run) AS missing_count FROM (
  SELECT employer_id, employer_name, island, count(*) AS run FROM (
    SELECT *, k - row_number() OVER (PARTITION BY employer_id ORDER BY k) AS island FROM missing)
  GROUP BY 1, 2, 3)
GROUP BY 1, 2 HAVING max(run) >= {p['min_missing']}"""
    else:
        body = f"""
SELECT employer_id, employer_name, count(*) AS missing_count FROM missing
GROUP BY 1, 2 HAVING count(*) >= {p['min_missing']}"""
    return _sql(body, DEP, grid, active, missing)


S["employer_arrears"] = _arrears_sql(P["employer_arrears"])
S["employer_arrears_consecutive"] = _arrears_sql(P["employer_arrears_consecutive"])

S["account_opening_anomalies"] = _sql(f"""
SELECT s.employer_id, s.employer_name, s.account_count, s.first_open_date, s.last_open_date,
       coalesce(dm.duplicate_person_count, 0) AS duplicate_person_count
FROM stats s LEFT JOIN dm USING (employer_id)
WHERE s.account_count > 1 OR coalesce(dm.duplicate_person_count, 0) > 0""",
                                      f"""stats AS (SELECT employer_id, count(*) AS account_count,
                         min(employer_name) AS employer_name, min(open_date) AS first_open_date,
                         max(open_date) AS last_open_date
  FROM employers WHERE open_date >= DATE '{AUDIT_AS_OF}' - INTERVAL 12 MONTH GROUP BY employer_id)""",
                                      """dup AS (SELECT id_number FROM persons WHERE id_number IS NOT NULL
  GROUP BY id_number HAVING count(*) > 1)""",
                                      """dm AS (SELECT employer_id, count(*) AS duplicate_person_count
  FROM persons JOIN dup USING (id_number) GROUP BY employer_id)""")

_RECENT = f"""rl AS (SELECT loan_id, person_id, apply_date FROM loans
  WHERE apply_date >= DATE '{AUDIT_AS_OF}' - INTERVAL 12 MONTH)"""
_PAIRS = """j AS (SELECT rl.person_id, p.employer_id, e.employer_name, p.deposit_base, rl.apply_date, d.dep_date,
         d.amount, d.memo
  FROM rl JOIN persons p USING (person_id) JOIN employers e USING (employer_id)
  JOIN dep d ON d.person_id = rl.person_id AND d.dep_date >= rl.apply_date - INTERVAL 12 MONTH
            AND d.dep_date <= rl.apply_date)"""

S["pre_loan_surge"] = _sql(f"""
SELECT employer_id, employer_name, count(*) AS surge_person_count,
       round(avg((avg_recent - avg_normal) / avg_normal * 100), 4) AS avg_increase_pct
FROM per
WHERE avg_normal IS NOT NULL AND avg_recent IS NOT NULL
  AND (avg_recent - avg_normal) / avg_normal >= {P['pre_loan_surge']['min_increase']}
GROUP BY employer_id, employer_name""", DEP, _RECENT, _PAIRS, """per AS (
  SELECT person_id, employer_id, employer_name,
         avg(CASE WHEN dep_date <= apply_date - INTERVAL 6 MONTH THEN amount END) AS avg_normal,
         avg(CASE WHEN dep_date >= apply_date - INTERVAL 6 MONTH THEN amount END) AS avg_recent
  FROM j GROUP BY person_id, employer_id, employer_name)""")

S["headcount_mismatch"] = _sql("""
SELECT * FROM (
  SELECT e.employer_id, e.employer_name, e.headcount AS registered_count,
         coalesce(m.actual_deposit_count, 0) AS actual_deposit_count,
         e.headcount - coalesce(m.actual_deposit_count, 0) AS diff
  FROM employers e LEFT JOIN (SELECT employer_id, count(DISTINCT person_id) AS actual_deposit_count
                              FROM persons GROUP BY employer_id) m USING (employer_id))
WHERE diff > 0""")

S["makeup_arbitrage"] = _sql(f"""
SELECT employer_id, employer_name, count(*) AS arbitrage_person_count,
       round(avg(total_makeup / nullif(deposit_base, 0)), 4) AS avg_makeup_ratio
FROM per WHERE total_makeup > deposit_base * {P['makeup_arbitrage']['multiple']}
GROUP BY employer_id, employer_name""", DEP, _RECENT, _PAIRS, """per AS (
  SELECT person_id, employer_id, employer_name, deposit_base,
         sum(CASE WHEN memo ILIKE '%makeup%' THEN amount ELSE 0 END) AS total_makeup
  FROM j GROUP BY person_id, employer_id, employer_name, deposit_base)""")

S["post_loan_arrears"] = _sql(f"""
SELECT * FROM (
  SELECT employer_id, employer_name, total_borrowers, arrears_count,
         round(arrears_count * 100.0 / total_borrowers, 2) AS arrears_ratio
  FROM (
    SELECT rl.employer_id, e.employer_name, count(DISTINCT rl.person_id) AS total_borrowers,
           count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM dep d WHERE d.person_id = rl.person_id
                                                AND d.dep_date > rl.apply_date)
                               THEN rl.person_id END) AS arrears_count
    FROM (SELECT l.loan_id, l.person_id, p.employer_id, l.apply_date FROM loans l JOIN persons p USING (person_id)
          WHERE l.status = 'disbursed' AND l.apply_date >= DATE '{AUDIT_AS_OF}' - INTERVAL 12 MONTH) rl
    JOIN employers e USING (employer_id)
    GROUP BY rl.employer_id, e.employer_name))
WHERE arrears_count > 0 AND arrears_ratio > {P['post_loan_arrears']['min_ratio']}""", DEP)

S["overdue_listing"] = _sql(f"""
SELECT o.loan_id, o.overdue_seq, l.person_id, o.overdue_days, o.overdue_total, o.grade, l.amount, l.status
FROM overdues o JOIN loans l USING (loan_id)
WHERE NOT o.settled AND o.overdue_days >= {P['overdue_listing']['min_days']}""")

S["loans_above"] = _sql("SELECT loan_id, person_id, amount, status FROM loans WHERE amount > 450000")
S["accounts_by_status"] = _sql("SELECT person_id, name, employer_id, balance FROM persons WHERE status = 'frozen'")
S["report_loans_by_status"] = _sql(
    "SELECT status, count(*) AS n, round(sum(amount), 2) AS total_amount FROM loans GROUP BY status")
S["report_ledger_by_type"] = _sql(
    "SELECT trans_type, count(*) AS n, round(sum(trans_amount), 2) AS total_amount FROM ledger GROUP BY trans_type")
S["report_employers_by_type"] = _sql("SELECT employer_type, count(*) AS n FROM employers GROUP BY employer_type")
S["report_accounts_by_status"] = _sql("SELECT status, count(*) AS n FROM persons GROUP BY status")
S["rule_custom"] = _sql("""
SELECT 'big_loans' AS rule_id, coalesce(count(*) > 0, false) AS detected,
       CASE WHEN count(*) > 0 THEN 'high' ELSE 'none' END AS level,
       CASE WHEN count(*) > 0 THEN 'loans above the limit' ELSE '' END AS message, count(*) AS n_rows
FROM loans WHERE amount > 450000 AND status <> 'closed'""")


def _finding_sql(rule: str, subject: str, subject_type: str, risk_type: str, level_sql: str, evidence) -> str:
    ev = ", ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '')" for c in evidence)
    score = (f"CAST(CASE WHEN ({level_sql}) = 'high' THEN 90 WHEN ({level_sql}) = 'medium' THEN 60 ELSE 30 END "
             f"AS INTEGER)")
    return (f"SELECT CAST({subject} AS VARCHAR) AS subject_id, '{subject_type}' AS subject_type, "
            f"'{risk_type}' AS risk_type, {score} AS score, concat_ws(';', {ev}) AS evidence "
            f"FROM ({S[rule]}) r_{rule}")


S["findings"] = "\nUNION ALL\n".join([
    _finding_sql("frequent_withdrawals", "person_id", "person", "frequent_withdrawal", "risk_level", ["times"]),
    _finding_sql("withdrawal_near_balance", "person_id", "person", "withdrawal_near_balance", "'medium'",
                 ["ledger_id"]),
    _finding_sql("loan_to_value", "loan_id", "loan", "loan_to_value", "risk_level", ["person_id"]),
    _finding_sql("debt_to_income", "loan_id", "loan", "debt_to_income", "'medium'", ["person_id"]),
    _finding_sql("duplicate_collateral", "loan_id", "loan", "duplicate_collateral", "'high'",
                 ["address", "loan_count"]),
    _finding_sql("dormant_reactivated", "person_id", "person", "dormant_reactivated", "'high'", ["ledger_id"]),
    _finding_sql("employer_arrears", "employer_id", "employer", "employer_arrears", "'high'", ["missing_count"]),
    _finding_sql("headcount_mismatch", "employer_id", "employer", "headcount_mismatch", "'medium'",
                 ["registered_count", "actual_deposit_count"]),
    _finding_sql("post_loan_arrears", "employer_id", "employer", "post_loan_arrears", "'high'",
                 ["total_borrowers", "arrears_count"]),
    _finding_sql("overdue_listing", "loan_id", "loan", "overdue", "'low'", ["overdue_seq", "overdue_days"]),
    _finding_sql("remote_withdrawals", "person_id", "person", "remote_withdrawal", "'medium'", ["ledger_id"]),
    _finding_sql("high_base_before_application", "loan_id", "loan", "high_base_before_application", "'low'",
                 ["person_id"]),
    _finding_sql("off_hours_summary", "person_id", "person", "off_hours", "'low'", ["night_count", "weekend_count"]),
    _finding_sql("account_opening_anomalies", "employer_id", "employer", "account_opening", "'medium'",
                 ["account_count", "duplicate_person_count"]),
    _finding_sql("pre_loan_surge", "employer_id", "employer", "pre_loan_surge", "'high'", ["surge_person_count"]),
    _finding_sql("makeup_arbitrage", "employer_id", "employer", "makeup_arbitrage", "'high'",
                 ["arbitrage_person_count"]),
])
S["report_risk_by_type"] = "SELECT risk_type, count(*) AS n FROM (" + S["findings"] + ") f GROUP BY risk_type"
S["loans_with_status"] = _sql(
    "SELECT loan_id, person_id, amount, status, apply_date FROM loans WHERE status LIKE '%disb%'")
S["withdrawals"] = _sql(
    "SELECT ledger_id, person_id, trans_type, trans_amount, trans_ts, abstract FROM ledger WHERE trans_type LIKE '%purch%'")
# FLT-2: the optional subject filter, one rule per family
SUBJECT = {"frequent_withdrawals": ("person_id", 7), "duplicate_collateral": ("person_id", 7), "pre_loan_surge": ("employer_id", 3),
           "overdue_listing": ("person_id", 7)}
for rule, (column, value) in SUBJECT.items():
    S[rule + "_subject"] = f"SELECT * FROM ({S[rule]}) r WHERE {column} = {value}"

S["report_high_score_findings"] = (
    "SELECT * FROM (" + S["findings"] + ") f WHERE score > 80 "
    "ORDER BY score DESC, risk_type, subject_id, evidence LIMIT 20")


def _findings(spark, d):
    params = {k: v for k, v in P.items() if k != "employer_arrears_consecutive"}
    return R.findings(_t(spark, d), AUDIT_AS_OF, LEDGER_AS_OF, params)


@register("frequent_withdrawals", S["frequent_withdrawals"], "AU-1")
def q_frequent_withdrawals(spark, d):
    return R.frequent_withdrawals(_t(spark, d), LEDGER_AS_OF, **P["frequent_withdrawals"])


@register("remote_withdrawals", S["remote_withdrawals"], "AU-2/SC-12")
def q_remote_withdrawals(spark, d):
    return R.remote_withdrawals(_t(spark, d), LEDGER_AS_OF, **P["remote_withdrawals"])


@register("withdrawal_near_balance", S["withdrawal_near_balance"], "AU-3/FLT-5")
def q_withdrawal_near_balance(spark, d):
    return R.withdrawal_near_balance(_t(spark, d), LEDGER_AS_OF, **P["withdrawal_near_balance"])


@register("loan_to_value", S["loan_to_value"], "AU-4")
def q_loan_to_value(spark, d):
    return R.loan_to_value(_t(spark, d), **P["loan_to_value"])


@register("debt_to_income", S["debt_to_income"], "AU-5")
def q_debt_to_income(spark, d):
    return R.debt_to_income(_t(spark, d), **P["debt_to_income"])


@register("duplicate_collateral", S["duplicate_collateral"], "AU-6/AG-5")
def q_duplicate_collateral(spark, d):
    return R.duplicate_collateral(_t(spark, d))


@register("high_base_before_application", S["high_base_before_application"], "AU-7")
def q_high_base(spark, d):
    return R.high_base_before_application(_t(spark, d), AUDIT_AS_OF, **P["high_base_before_application"])


@register("dormant_reactivated", S["dormant_reactivated"], "AU-8")
def q_dormant(spark, d):
    return R.dormant_reactivated(_t(spark, d), **P["dormant_reactivated"])


@register("off_hours_operations", S["off_hours_operations"], "AU-9")
def q_off_hours(spark, d):
    return R.off_hours_operations(_t(spark, d))


@register("off_hours_summary", S["off_hours_summary"], "AU-9")
def q_off_hours_summary(spark, d):
    return R.off_hours_summary(_t(spark, d))


@register("employer_arrears", S["employer_arrears"], "AU-10/RSH-6/JN-8")
def q_employer_arrears(spark, d):
    return R.employer_arrears(_t(spark, d), AUDIT_AS_OF, **P["employer_arrears"])


@register("employer_arrears_consecutive", S["employer_arrears_consecutive"], "AU-10")
def q_employer_arrears_consecutive(spark, d):
    return R.employer_arrears(_t(spark, d), AUDIT_AS_OF, **P["employer_arrears_consecutive"])


@register("account_opening_anomalies", S["account_opening_anomalies"], "AU-11")
def q_account_opening(spark, d):
    return R.account_opening_anomalies(_t(spark, d), AUDIT_AS_OF)


@register("pre_loan_surge", S["pre_loan_surge"], "AU-12/JN-7")
def q_pre_loan_surge(spark, d):
    return R.pre_loan_surge(_t(spark, d), AUDIT_AS_OF, **P["pre_loan_surge"])


@register("headcount_mismatch", S["headcount_mismatch"], "AU-13")
def q_headcount(spark, d):
    return R.headcount_mismatch(_t(spark, d))


@register("makeup_arbitrage", S["makeup_arbitrage"], "AU-14")
def q_makeup(spark, d):
    return R.makeup_arbitrage(_t(spark, d), AUDIT_AS_OF, **P["makeup_arbitrage"])


@register("post_loan_arrears", S["post_loan_arrears"], "AU-15/JN-5")
def q_post_loan_arrears(spark, d):
    return R.post_loan_arrears(_t(spark, d), AUDIT_AS_OF, **P["post_loan_arrears"])


@register("overdue_listing", S["overdue_listing"], "AU-16")
def q_overdue_listing(spark, d):
    return R.overdue_listing(_t(spark, d), **P["overdue_listing"])


@register("loans_above", S["loans_above"], "AU-17")
def q_loans_above(spark, d):
    return R.loans_above(_t(spark, d), 450000)


@register("accounts_by_status", S["accounts_by_status"], "AU-17")
def q_accounts_by_status(spark, d):
    return R.accounts_by_status(_t(spark, d), "frozen")


@register("report_loans_by_status", S["report_loans_by_status"], "AU-19")
def q_report_loans(spark, d):
    return R.report(_t(spark, d).loans, "status", "amount")


@register("report_ledger_by_type", S["report_ledger_by_type"], "AU-19")
def q_report_ledger(spark, d):
    return R.report(_t(spark, d).ledger, "trans_type", "trans_amount")


@register("report_employers_by_type", S["report_employers_by_type"], "AU-19")
def q_report_employers(spark, d):
    return R.report(_t(spark, d).employers, "employer_type")


@register("report_accounts_by_status", S["report_accounts_by_status"], "AU-19")
def q_report_accounts(spark, d):
    return R.report(_t(spark, d).persons, "status")


@register("rule_custom", S["rule_custom"], "AU-18")
def q_rule_custom(spark, d):
    t = _t(spark, d)
    return R.custom_rule(spark, "big_loans", "SELECT * FROM {loans} WHERE amount > :min_amount AND status <> :closed",
                         {"min_amount": 450000, "closed": "closed"}, "count(*) > 0", "high",
                         "loans above the limit", tables={"loans": t.loans})


@register("findings", S["findings"], "AU-20")
def q_findings(spark, d):
    return _findings(spark, d)


@register("report_high_score_findings", S["report_high_score_findings"], "AU-19/SRT-1")
def q_high_score(spark, d):
    f = _findings(spark, d).where(F.col("score") > 80)
    return f.orderBy(F.col("score").desc(), "risk_type", "subject_id", "evidence").limit(20)


@register("report_risk_by_type", S["report_risk_by_type"], "AU-19")
def q_risk_by_type(spark, d):
    return R.report(_findings(spark, d), "risk_type").orderBy(F.col("n").desc(), "risk_type")


@register("loans_with_status", S["loans_with_status"], "AU-17")
def q_loans_with_status(spark, d):
    return R.loans_with_status(_t(spark, d), "%disb%")


@register("withdrawals", S["withdrawals"], "AU-17")
def q_withdrawals(spark, d):
    return R.withdrawals(_t(spark, d), "%purch%")


@register("frequent_withdrawals_subject", S["frequent_withdrawals_subject"], "FLT-2")
def q_frequent_withdrawals_subject(spark, d):
    return R.frequent_withdrawals(_t(spark, d), LEDGER_AS_OF, subject=7, **P["frequent_withdrawals"])


@register("duplicate_collateral_subject", S["duplicate_collateral_subject"], "FLT-2")
def q_duplicate_collateral_subject(spark, d):
    return R.duplicate_collateral(_t(spark, d), subject=7)


@register("pre_loan_surge_subject", S["pre_loan_surge_subject"], "FLT-2")
def q_pre_loan_surge_subject(spark, d):
    return R.pre_loan_surge(_t(spark, d), AUDIT_AS_OF, subject=3, **P["pre_loan_surge"])


@register("overdue_listing_subject", S["overdue_listing_subject"], "FLT-2")
def q_overdue_listing_subject(spark, d):
    return R.overdue_listing(_t(spark, d), subject=7, **P["overdue_listing"])
