"""Golden cases for the audit rules: one hit, one just under the limit, one
outside the date window each (hand-built fixtures)."""
import datetime as dt

import pytest

from fundscope.plans import rules as R

P_SCHEMA = "person_id long, name string, employer_id int, id_number string, deposit_base double, " \
           "balance double, status string"
E_SCHEMA = "employer_id int, employer_name string, employer_type int, open_date date, headcount int"
D_SCHEMA = "deposit_id long, person_id long, dep_date date, amount double, memo string"
L_SCHEMA = "loan_id long, person_id long, amount double, house_price double, address string, status string, " \
           "term_months int, apply_date date"
G_SCHEMA = "ledger_id long, person_id long, trans_type string, trans_amount double, trans_ts timestamp_ntz, " \
           "abstract string, ext_info string"
O_SCHEMA = "loan_id long, overdue_seq int, overdue_days int, overdue_total double, grade string, settled boolean"

D = dt.date
T = dt.datetime


def tables(spark, persons=(), employers=(), deposits=(), loans=(), ledger=(), overdues=()):
    mk = spark.createDataFrame
    return R.AuditTables(mk(list(persons), P_SCHEMA), mk(list(employers), E_SCHEMA), mk(list(deposits), D_SCHEMA),
                         mk(list(loans), L_SCHEMA), mk(list(ledger), G_SCHEMA), mk(list(overdues), O_SCHEMA))


def person(pid, emp=1, base=1000.0, bal=10000.0, idn=None, status="normal"):
    return (pid, f"P{pid}", emp, idn or f"ID{pid}", base, bal, status)


def test_frequent_withdrawals(spark):
    led = [(i, 1, "withdraw", 10.0, T(2024, 1, i + 1), "house purchase", None) for i in range(2)] + \
          [(10 + i, 2, "withdraw", 10.0, T(2024, 1, i + 1), "house purchase", None) for i in range(3)] + \
          [(20, 3, "withdraw", 10.0, T(2024, 1, 5), "house purchase", None),
           (21, 3, "withdraw", 10.0, T(2023, 1, 5), "house purchase", None)]   # second one outside 6 months
    t = tables(spark, persons=[person(1), person(2), person(3)], ledger=led)
    got = {r["person_id"]: r["risk_level"] for r in
           R.frequent_withdrawals(t, "2024-01-31", trans_type="withdraw", text_like="%purchase%").collect()}
    assert got == {1: "medium", 2: "high"}


def test_ltv_boundary(spark):
    loans = [(1, 1, 80.0, 100.0, "a", "pending", 12, D(2024, 1, 1)),      # exactly 80 -> no finding
             (2, 1, 8001.0, 10000.0, "a", "disbursed", 12, D(2024, 1, 1)),  # 80.01 -> finding, high
             (3, 1, 95.0, 100.0, "a", "closed", 12, D(2024, 1, 1))]        # closed -> ignored
    t = tables(spark, persons=[person(1)], loans=loans)
    got = {r["loan_id"]: (r["loan_ratio"], r["risk_level"]) for r in R.loan_to_value(t).collect()}
    assert got == {2: (80.01, "high")}


def test_duplicate_collateral_and_dti(spark):
    loans = [(1, 1, 1000.0, 2000.0, "x", "pending", 12, D(2024, 1, 1)),
             (2, 2, 1000.0, 2000.0, "x", "disbursed", 12, D(2024, 1, 1)),
             (3, 3, 1000.0, 2000.0, "x", "closed", 12, D(2024, 1, 1)),
             (4, 3, 1000.0, 2000.0, None, "pending", 12, D(2024, 1, 1)),
             (5, 3, 1000.0, 2000.0, None, "pending", 12, D(2024, 1, 1))]
    t = tables(spark, persons=[person(1, base=100.0), person(2, base=10.0), person(3)], loans=loans)
    dup = sorted((r["loan_id"], r["loan_count"]) for r in R.duplicate_collateral(t).collect())
    assert dup == [(1, 2), (2, 2)]
    dti = {r["loan_id"]: r["estimated_dti"] for r in R.debt_to_income(t, threshold=1.0).collect()}
    assert dti == {2: 8.33}   # 1000 / (10*12); person 1 gives 0.83 (below)


def test_dormant_reactivated(spark):
    led = [(1, 1, "t", 10.0, T(2020, 1, 1), "", None), (2, 1, "t", 50000.01, T(2021, 1, 1, 0, 0, 1), "", None),
           (3, 2, "t", 10.0, T(2020, 1, 1), "", None), (4, 2, "t", 50000.00, T(2021, 1, 2), "", None),
           (5, 3, "t", 10.0, T(2020, 1, 1), "", None), (6, 3, "t", 60000.0, T(2020, 12, 31), "", None)]
    t = tables(spark, persons=[person(1), person(2), person(3)], ledger=led)
    got = [r["ledger_id"] for r in R.dormant_reactivated(t, dormant_days=365, min_amount=50000).collect()]
    assert got == [2]   # 366 days + 1 s and 50000.01; person 2 amount not above; person 3 gap 365 days


def test_off_hours(spark):
    led = [(h, 1, "t", 1.0, T(2024, 1, 3, h, 0), "", None) for h in (7, 8, 22, 23)] + \
          [(100, 1, "t", 1.0, T(2024, 1, 6, 12), "", None), (101, 1, "t", 1.0, T(2024, 1, 7, 12), "", None)]
    t = tables(spark, persons=[person(1)], ledger=led)
    got = sorted(r["ledger_id"] for r in R.off_hours_operations(t).collect())
    assert got == [7, 23, 100, 101]     # 2024-01-03 is a Wednesday; 6th Saturday, 7th Sunday
    s = R.off_hours_summary(t).first()
    assert (s["night_count"], s["weekend_count"], s["off_hours_count"]) == (2, 2, 4)


def _monthly(pid, months, day=15):
    return [(pid * 100 + m, pid, D(2024, m, day), 100.0, "regular deposit") for m in months]


def test_employer_arrears(spark):
    emps = [(e, f"E{e}", 1, D(2020, 1, 1), 10) for e in (1, 2, 3)]
    # as_of 2024-06-30: months Jan..Jun; employer 1 misses 2 (scattered), 2 misses 3 scattered, 3 misses 3 in a row
    deps = _monthly(1, [1, 3, 4, 6]) + _monthly(2, [2, 4, 6]) + _monthly(3, [1, 2, 3])
    t = tables(spark, persons=[person(1, emp=1), person(2, emp=2), person(3, emp=3)], employers=emps, deposits=deps)
    anyc = {r["employer_id"]: r["missing_count"] for r in R.employer_arrears(t, "2024-06-30").collect()}
    assert anyc == {2: 3, 3: 3}
    cons = {r["employer_id"]: r["missing_count"] for r in
            R.employer_arrears(t, "2024-06-30", consecutive=True).collect()}
    assert cons == {3: 3}


def test_surge_and_makeup(spark):
    emps = [(1, "E1", 1, D(2020, 1, 1), 10)]
    loans = [(1, 1, 1.0, 2.0, "a", "disbursed", 12, D(2024, 6, 1)), (2, 2, 1.0, 2.0, "b", "disbursed", 12,
                                                                    D(2024, 6, 1))]
    deps = [(1, 1, D(2023, 9, 1), 100.0, "regular deposit"), (2, 1, D(2024, 3, 1), 149.0, "regular deposit"),  # 49 %
            (3, 2, D(2023, 9, 1), 100.0, "regular deposit"), (4, 2, D(2024, 3, 1), 150.0, "regular deposit")]  # 50 %
    t = tables(spark, persons=[person(1), person(2)], employers=emps, deposits=deps, loans=loans)
    s = R.pre_loan_surge(t, "2024-07-01").collect()
    assert len(s) == 1 and s[0]["surge_person_count"] == 1 and abs(s[0]["avg_increase_pct"] - 50.0) < 1e-9
    mk = [(10, 1, D(2024, 1, 1), 600.0, "makeup deposit"), (11, 2, D(2024, 1, 1), 600.01, "makeup deposit")]
    t2 = tables(spark, persons=[person(1, base=100.0), person(2, base=100.0)], employers=emps, deposits=mk,
                loans=loans)
    m = R.makeup_arbitrage(t2, "2024-07-01").collect()
    assert len(m) == 1 and m[0]["arbitrage_person_count"] == 1   # exactly 6x is not above


def test_post_loan_arrears(spark):
    emps = [(1, "E1", 1, D(2020, 1, 1), 10), (2, "E2", 1, D(2020, 1, 1), 10)]
    persons = [person(p, emp=1) for p in range(1, 6)] + [person(p, emp=2) for p in range(6, 11)]
    loans = [(p, p, 1.0, 2.0, "a", "disbursed", 12, D(2024, 3, 1)) for p in range(1, 11)]
    later = [p for p in range(1, 11) if p not in (1, 6, 7)]     # E1: 1 of 5 without; E2: 2 of 5 without
    deps = [(p, p, D(2024, 4, 1), 10.0, "regular deposit") for p in later] + \
           [(100 + p, p, D(2024, 2, 1), 10.0, "regular deposit") for p in (1, 6, 7)]
    t = tables(spark, persons=persons, employers=emps, deposits=deps, loans=loans)
    got = {r["employer_id"]: r["arrears_ratio"] for r in R.post_loan_arrears(t, "2024-06-30").collect()}
    assert got == {2: 40.0}   # 20 % is not above the limit


def test_headcount_and_opening(spark):
    emps = [(1, "E1", 1, D(2024, 1, 1), 3), (2, "E2", 1, D(2024, 1, 1), 1), (2, "E2", 1, D(2024, 2, 1), 1)]
    persons = [person(1, emp=1, idn="X"), person(2, emp=1, idn="X"), person(3, emp=2)]
    t = tables(spark, persons=persons, employers=emps)
    hc = {r["employer_id"]: r["diff"] for r in R.headcount_mismatch(t).collect()}
    assert hc == {1: 1}
    op = {r["employer_id"]: (r["account_count"], r["duplicate_person_count"]) for r in
          R.account_opening_anomalies(t, "2024-06-30").collect()}
    assert op == {1: (1, 2), 2: (2, 0)}


def test_custom_rule(spark):
    t = tables(spark, persons=[person(1)], loans=[(1, 1, 500.0, 600.0, "a", "pending", 12, D(2024, 1, 1))])
    r = R.custom_rule(spark, "big", "SELECT * FROM {loans} WHERE amount > :m", {"m": 100}, "count(*) > 0", "high",
                      "found", tables={"loans": t.loans}).first()
    assert r["detected"] and r["level"] == "high" and r["n_rows"] == 1
    r2 = R.custom_rule(spark, "big", "SELECT * FROM {loans} WHERE amount > :m", {"m": 1000}, "count(*) > 0", "high",
                       "found", tables={"loans": t.loans}).first()
    assert not r2["detected"] and r2["level"] == "none"


@pytest.mark.parametrize("limit", [None, 1])
def test_overdue_listing(spark, limit):
    t = tables(spark, persons=[person(1)], loans=[(1, 1, 5.0, 6.0, "a", "pending", 12, D(2024, 1, 1))],
               overdues=[(1, 1, 30, 1.0, "A", False), (1, 2, 90, 2.0, "B", False), (1, 3, 120, 3.0, "C", True)])
    got = [r["overdue_days"] for r in R.overdue_listing(t, min_days=30, limit=limit).collect()]
    if limit:
        assert got == [90]          # top-k by days
    else:
        assert sorted(got) == [30, 90]   # settled record excluded
