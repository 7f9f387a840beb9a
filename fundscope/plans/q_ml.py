"""Registered ML queries (FE-*, ML-*)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources.adapters import AUDIT_AS_OF
from ..session import written_table_dir
from ..sources.tables import Catalog
from . import medallion as M
from . import ml as ML
from . import rules as R
from .q_models import GOLD_SQL
from .q_rules import ALL, S as RULE_SQL
from .registry import register


def _gold(spark, d):
    return M.build_gold(Catalog(spark, d))


def _rounded(df, skip=()):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


def _code_sql(col, codes, default):
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in codes.items())
    return f"CAST(CASE {whens} ELSE {default} END AS DOUBLE)"


_ENC = f"""enc AS (
  SELECT contract_id, CAST(age AS DOUBLE) AS age_d, CAST(monthly_income AS DOUBLE) AS inc,
         CAST(loan_amount AS DOUBLE) AS amt, CAST(credit_score AS DOUBLE) AS cs, CAST(city_tier AS DOUBLE) AS tier,
         CAST(loan_period_months AS DOUBLE) AS months,
         {_code_sql('gender', ML.GENDER_CODES, ML.GENDER_DEFAULT)} AS gender_c,
         {_code_sql('occupation', ML.OCCUPATION_CODES, ML.OCCUPATION_DEFAULT)} AS occ_c,
         {_code_sql('dti_category', ML.DTI_CODES, ML.DTI_DEFAULT)} AS dti_c,
         {_code_sql('age_group', ML.AGE_CODES, ML.AGE_DEFAULT)} AS age_c,
         {_code_sql('income_level', ML.INCOME_CODES, ML.INCOME_DEFAULT)} AS inc_c,
         {_code_sql('loan_duration_type', ML.DURATION_CODES, ML.DURATION_DEFAULT)} AS dur_c,
         target_label
  FROM gold),
f AS (
  SELECT *, amt / nullif(inc + 1.0, 0) AS dti, (cs - 300) / 550 AS sn, amt / nullif(months + 1, 0) AS pay FROM enc)"""

_ENC_SELECT = """
SELECT contract_id, round(coalesce(age_d, 0), 6) AS age, round(gender_c, 6) AS gender,
       round(coalesce(inc, 0), 6) AS monthly_income, round(occ_c, 6) AS occupation,
       round(coalesce(tier, 0), 6) AS city_tier, round(coalesce(cs, 0), 6) AS credit_score,
       round(coalesce(amt, 0), 6) AS loan_amount, round(coalesce(months, 0), 6) AS loan_period_months,
       round(dti_c, 6) AS dti_category, round(age_c, 6) AS age_group, round(inc_c, 6) AS income_level,
       round(dur_c, 6) AS loan_duration_type, round(coalesce(dti, 0), 6) AS dti_ratio,
       round(coalesce(age_d * dti, 0), 6) AS age_dti_interaction,
       round(coalesce(CASE WHEN inc > -1 THEN ln(1 + inc) END, 0), 6) AS log_income,
       round(coalesce(inc / nullif(amt + 1, 0), 0), 6) AS income_loan_ratio, round(coalesce(sn, 0), 6) AS credit_score_norm,
       round(coalesce(dti * (1 - sn), 0), 6) AS dti_credit_risk, round(coalesce(pay, 0), 6) AS monthly_payment,
       round(coalesce(pay / nullif(inc + 1, 0), 0), 6) AS payment_income_ratio,
       round(coalesce(age_d * sn, 0), 6) AS age_credit_interaction, round(occ_c / 6.0, 6) AS occupation_risk,
       round(coalesce((4 - tier) / 3.0, 0), 6) AS city_risk, CAST(target_label AS INTEGER) AS target_label
FROM f"""


@register("ml_encoded_features", "WITH gold AS (" + GOLD_SQL + "),\n" + _ENC + _ENC_SELECT, "FE-1/FE-2/FE-3")
def ml_encoded_features(spark, d):
    return _rounded(ML.encode(_gold(spark, d)))


_RISK_EVENTS = ("ev AS (SELECT person_id AS subject_id, count(*) AS risk_event_count FROM ("
                + RULE_SQL["off_hours_operations"] + ") GROUP BY person_id)")
_BEHAV = """beh AS (
  SELECT l.loan_id, l.person_id, l.amount, coalesce(nullif(l.term_months, 0), 120) AS term_months,
         CASE WHEN l.amount / coalesce(nullif(l.term_months, 0), 120) > 0
              THEN round((p.balance + p.deposit_base) / (l.amount / coalesce(nullif(l.term_months, 0), 120)), 2)
              ELSE 999.0 END AS balance_coverage,
         CAST(p.status IS DISTINCT FROM 'normal' AS INTEGER) AS deposit_abnormal,
         coalesce(od.overdue_count, 0) AS overdue_count, coalesce(ev.risk_event_count, 0) AS risk_event_count
  FROM loans l LEFT JOIN persons p USING (person_id)
  LEFT JOIN (SELECT loan_id, count(*) AS overdue_count FROM overdues GROUP BY loan_id) od USING (loan_id)
  LEFT JOIN ev ON ev.subject_id = l.person_id
  WHERE l.status = 'disbursed')"""
_SCORE = """sc AS (
  SELECT *, CAST(least(100, greatest(0, deposit_abnormal * 40 + CASE WHEN overdue_count > 0 THEN 30 ELSE 0 END
         + CASE WHEN balance_coverage < 1 THEN 25 WHEN balance_coverage < 3 THEN 15 ELSE 0 END)) AS INTEGER)
         AS rule_score
  FROM beh)"""


def _risk_events(t: R.AuditTables):
    return R.off_hours_operations(t).select(F.col("person_id").alias("subject_id"))


def _behaviour(spark, d):
    t = R.AuditTables.from_catalog(Catalog(spark, d))
    return t, ML.behaviour_features(t, _risk_events(t))


@register("ml_behaviour_features", ALL + ",\n" + _RISK_EVENTS + ",\n" + _BEHAV + "\nSELECT * FROM beh", "FE-4/JN-6")
def ml_behaviour_features(spark, d):
    return _behaviour(spark, d)[1]


@register("ml_rule_score", ALL + ",\n" + _RISK_EVENTS + ",\n" + _BEHAV + ",\n" + _SCORE + "\nSELECT * FROM sc",
          "ML-13")
def ml_rule_score(spark, d):
    return ML.rule_score(_behaviour(spark, d)[1])


def _scored_gold(spark, d):
    """Gold rows with the rule score of the same loan as default probability."""
    _, beh = _behaviour(spark, d)
    sc = ML.rule_score(beh).select(F.col("loan_id").alias("contract_id"),
                                   (F.col("rule_score") / 100.0).alias("probability_default"))
    return _gold(spark, d).join(sc, "contract_id")


_GOLD_SC = ("gold AS (" + GOLD_SQL + "),\n" + _RISK_EVENTS + ",\n" + _BEHAV + ",\n" + _SCORE
            + ",\ngs AS (SELECT g.*, s.rule_score / 100.0 AS probability_default FROM gold g "
              "JOIN sc s ON g.contract_id = s.loan_id)")


@register("ml_band", ALL + ",\n" + _GOLD_SC + """
SELECT contract_id, probability_default,
       CASE WHEN probability_default < 0.3 THEN 'low' WHEN probability_default < 0.7 THEN 'medium' ELSE 'high' END
         AS risk_level,
       CASE WHEN probability_default < 0.3 THEN 'approve' WHEN probability_default < 0.7 THEN 'manual_review'
            ELSE 'reject' END AS decision,
       concat_ws(', ',
         CASE WHEN CAST(loan_amount AS DOUBLE) / nullif(CAST(monthly_income AS DOUBLE) * 12, 0) > 3 THEN 'very high DTI'
              WHEN CAST(loan_amount AS DOUBLE) / nullif(CAST(monthly_income AS DOUBLE) * 12, 0) > 2 THEN 'high DTI' END,
         CASE WHEN credit_score < 580 THEN 'very low credit score' WHEN credit_score < 650 THEN 'low credit score' END,
         CASE WHEN monthly_income < 5000 THEN 'low income' END,
         CASE WHEN loan_period_months > 240 THEN 'long term' END) AS reasons
FROM gs""", "ML-9")
def ml_band(spark, d):
    b = ML.band(_scored_gold(spark, d))
    return b.select("contract_id", "probability_default", "risk_level", "decision", "reasons")


@register("ml_validate", "WITH gold AS (" + GOLD_SQL + """)
SELECT contract_id, r = '' AS is_valid, r AS invalid_reasons FROM (
  SELECT contract_id, concat_ws(',',
    CASE WHEN NOT coalesce(age BETWEEN 18 AND 70, false) THEN 'age' END,
    CASE WHEN NOT coalesce(monthly_income > 0, false) THEN 'monthly_income' END,
    CASE WHEN NOT coalesce(city_tier BETWEEN 1 AND 3, false) THEN 'city_tier' END,
    CASE WHEN NOT coalesce(credit_score BETWEEN 300 AND 850, false) THEN 'credit_score' END,
    CASE WHEN NOT coalesce(gender IN ('M', 'F'), false) THEN 'gender' END,
    CASE WHEN NOT coalesce(occupation IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'), false)
         THEN 'occupation' END,
    CASE WHEN NOT coalesce(loan_amount > 0, false) THEN 'loan_amount' END,
    CASE WHEN NOT coalesce(loan_period_months > 0, false) THEN 'loan_period_months' END) AS r
  FROM gold)""", "ML-10")
def ml_validate(spark, d):
    v = ML.validate_applications(_gold(spark, d), occupations=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"))
    return v.select("contract_id", "is_valid", "invalid_reasons")


_CM_SQL = """
cm AS (SELECT
  sum(CASE WHEN target_label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS n00,
  sum(CASE WHEN target_label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS n01,
  sum(CASE WHEN target_label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS n10,
  sum(CASE WHEN target_label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS n11
  FROM (SELECT target_label, CAST(probability_default >= 0.5 AS INTEGER) AS pred FROM gs)),
k AS (SELECT 0 AS class, n00 AS tp, n10 AS fp, n01 AS fn, n00, n01, n10, n11 FROM cm
      UNION ALL SELECT 1, n11, n01, n10, n00, n01, n10, n11 FROM cm),
m AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS prec, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS rec
      FROM k)
SELECT class, CAST(tp AS BIGINT) AS true_pos, CAST(fp AS BIGINT) AS false_pos, CAST(fn AS BIGINT) AS false_neg,
       round(prec, 6) AS precision, round(rec, 6) AS recall, round(2 * prec * rec / nullif(prec + rec, 0), 6) AS f1,
       round(CAST(n00 + n11 AS DOUBLE) / nullif(n00 + n01 + n10 + n11, 0), 6) AS accuracy,
       CAST(tp + fn AS BIGINT) AS support
FROM m"""


@register("ml_confusion", ALL + ",\n" + _GOLD_SC + "," + _CM_SQL, "ML-5")
def ml_confusion(spark, d):
    s = _scored_gold(spark, d).withColumn("predicted_label", (F.col("probability_default") >= 0.5).cast("int"))
    return ML.classification_report(s)


_CURVE = """
per AS (SELECT {p} AS threshold, count(*) FILTER (WHERE target_label = 1) AS pos, count(*) AS n FROM {t} GROUP BY 1),
cum AS (SELECT threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS hit, (SELECT sum(pos) FROM per) AS P FROM per
        WINDOW w AS (ORDER BY threshold DESC)),
best AS (SELECT threshold, round(tp / hit, 6) AS precision, round(tp / P, 6) AS recall, round(2 * tp / (hit + P), 6) AS f1
  FROM cum ORDER BY f1 DESC NULLS LAST, threshold DESC LIMIT 1)"""


@register("ml_best_threshold", ALL + ",\n" + _GOLD_SC + "," + _CURVE.format(p="probability_default", t="gs") + "\nSELECT * FROM best", "ML-4")
def ml_best_threshold(spark, d):
    return ML.best_threshold(_scored_gold(spark, d))


# two fixed scores stand in for models, so that the choice has one right answer
_TWO = "two AS (SELECT *, probability_default AS p_rule, (850 - credit_score) / 550.0 AS p_credit, " \
       "(probability_default + (850 - credit_score) / 550.0) / 2 AS p_ensemble FROM gs)"


def _two_scores(spark, d):
    s = _scored_gold(spark, d).withColumn("p_rule", F.col("probability_default")).withColumn(
        "p_credit", (850 - F.col("credit_score")) / 550.0)
    return ML.ensemble(s, ["p_rule", "p_credit"])


@register("ml_ensemble", ALL + ",\n" + _GOLD_SC + ",\n" + _TWO + """
SELECT contract_id, round(p_rule, 6) AS p_rule, round(p_credit, 6) AS p_credit, round(p_ensemble, 6) AS p_ensemble FROM two""", "ML-3")
def ml_ensemble(spark, d):
    return _rounded(_two_scores(spark, d).select("contract_id", "p_rule", "p_credit", "p_ensemble"))


@register("ml_choose_model", ALL + ",\n" + _GOLD_SC + ",\n" + _TWO + """,
long AS (SELECT 1 AS i, 'rule' AS model, p_rule AS p, target_label FROM two UNION ALL SELECT 2, 'credit', p_credit, target_label FROM two
         UNION ALL SELECT 3, 'ensemble', p_ensemble, target_label FROM two),
f AS (SELECT i, model, coalesce(2.0 * count(*) FILTER (WHERE p >= 0.5 AND target_label = 1)
        / nullif(count(*) FILTER (WHERE p >= 0.5) + count(*) FILTER (WHERE target_label = 1), 0), 0) AS f1 FROM long GROUP BY 1, 2),
c AS (SELECT * FROM f ORDER BY f1 DESC, i LIMIT 1),
z AS (SELECT p, target_label FROM long JOIN c USING (model)),""" + _CURVE.format(p="p", t="z") + """,
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE (p >= threshold) = (target_label = 1)) AS ok,
             count(*) FILTER (WHERE target_label = 1) AS support FROM z, best)
SELECT model, round(c.f1, 6) AS f1_at_half, threshold, best.f1, precision, recall, round(ok / n, 6) AS accuracy, support
FROM c, best, n""", "ML-2/ML-3/ML-4")
def ml_choose_model(spark, d):
    return ML.choose_model(_two_scores(spark, d), ["rule", "credit"])


@register("ml_split", "WITH gold AS (" + GOLD_SQL + """)
SELECT contract_id, CAST('0x' || substr(md5(contract_id || '-42'), 1, 8) AS BIGINT) % 100 < 20 AS is_test FROM gold""", "ML-1")
def ml_split(spark, d):
    train, test = ML.split(_gold(spark, d).select("contract_id"), "contract_id")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


_EXISTING = """existing AS (SELECT 'E' || CAST(person_id AS VARCHAR) AS event_id, CAST(person_id AS VARCHAR) AS subject_id,
                     'person' AS subject_type, 'loan_default' AS risk_type, 70 AS score, 'account frozen' AS evidence,
                     'Pending' AS status, TIMESTAMP '2000-01-01 00:00:00' AS created_at
              FROM persons WHERE status = 'frozen')"""
_NEW = f"""new_ev AS (
  SELECT subject_id, 'person' AS subject_type, 'loan_default' AS risk_type, CAST(score AS INTEGER) AS score,
         'loan_id=' || CAST(loan_id AS VARCHAR) AS evidence, 'Pending' AS status,
         TIMESTAMP '{AUDIT_AS_OF} 00:00:00' AS created_at
  FROM (SELECT CAST(person_id AS VARCHAR) AS subject_id, rule_score AS score, loan_id,
               row_number() OVER (PARTITION BY person_id ORDER BY rule_score DESC, loan_id) AS rn
        FROM sc WHERE rule_score >= 50) b
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.status = 'Pending'
                               AND e.subject_id = b.subject_id AND e.risk_type = 'loan_default'))"""


def _existing_events(t: R.AuditTables):
    return t.persons.where(F.col("status") == "frozen").select(
        F.concat(F.lit("E"), F.col("person_id").cast("string")).alias("event_id"),
        F.col("person_id").cast("string").alias("subject_id"), F.lit("person").alias("subject_type"),
        F.lit("loan_default").alias("risk_type"), F.lit(70).alias("score"), F.lit("account frozen").alias("evidence"),
        F.lit("Pending").alias("status"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))


def _new_events(spark, d):
    t, beh = _behaviour(spark, d)
    sc = ML.rule_score(beh).select("person_id", "loan_id", F.col("rule_score").alias("score"))
    existing = _existing_events(t)
    return t, existing, ML.new_risk_events(sc, existing, created_at=f"{AUDIT_AS_OF} 00:00:00")


@register("ml_new_risk_events", ALL + ",\n" + _RISK_EVENTS + ",\n" + _BEHAV + ",\n" + _SCORE + ",\n" + _EXISTING
          + ",\n" + _NEW + "\nSELECT * FROM new_ev", "ML-14/JN-11")
def ml_new_risk_events(spark, d):
    return _new_events(spark, d)[2]


@register("ml_feedback_close", ALL + ",\n" + _RISK_EVENTS + ",\n" + _BEHAV + ",\n" + _SCORE + ",\n" + _EXISTING
          + ",\n" + _NEW + """,
events AS (
  SELECT event_id, subject_id, subject_type, risk_type, score, evidence, status, created_at,
         CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS handler,
         CAST(NULL AS TIMESTAMP) AS handled_at FROM existing
  UNION ALL
  SELECT 'N' || subject_id, subject_id, subject_type, risk_type, score, evidence, status, created_at,
         NULL, NULL, NULL, NULL FROM new_ev),
fb AS (SELECT CAST(person_id AS VARCHAR) AS subject_id, 'loan_default' AS risk_type FROM persons WHERE balance < 0),
tgt AS (SELECT event_id FROM (
          SELECT e.event_id, row_number() OVER (PARTITION BY e.subject_id, e.risk_type
                                                ORDER BY e.created_at DESC, e.event_id DESC) AS rn
          FROM events e WHERE e.status <> 'Closed') x
        WHERE rn = 1 AND EXISTS (SELECT 1 FROM fb JOIN events e2 USING (subject_id, risk_type)
                                 WHERE e2.event_id = x.event_id))
SELECT event_id, subject_id, subject_type, risk_type, score, evidence, created_at,
       CASE WHEN event_id IN (SELECT event_id FROM tgt) THEN 'Closed' ELSE status END AS status,
       CASE WHEN event_id IN (SELECT event_id FROM tgt) THEN 'confirmed' ELSE verdict END AS verdict,
       CASE WHEN event_id IN (SELECT event_id FROM tgt) THEN 'negative balance' ELSE note END AS note,
       CASE WHEN event_id IN (SELECT event_id FROM tgt) THEN 'auditor' ELSE handler END AS handler,
       CASE WHEN event_id IN (SELECT event_id FROM tgt) THEN TIMESTAMP '2001-08-02 00:00:00' ELSE handled_at END
         AS handled_at
FROM events""", "ML-15")
def ml_feedback_close(spark, d):
    t, existing, new = _new_events(spark, d)
    nulls = [F.lit(None).cast("string").alias(c) for c in ("verdict", "note", "handler")] + \
            [F.lit(None).cast("timestamp_ntz").alias("handled_at")]
    events = existing.select("*", *nulls).unionByName(
        new.select(F.concat(F.lit("N"), F.col("subject_id")).alias("event_id"), "*", *nulls))
    fb = t.persons.where(F.col("balance") < 0).select(
        F.col("person_id").cast("string").alias("subject_id"), F.lit("loan_default").alias("risk_type"),
        F.lit("confirmed").alias("verdict"), F.lit("negative balance").alias("note"), F.lit("auditor").alias("handler"))
    return ML.close_with_feedback(events, fb, handled_at="2001-08-02 00:00:00")


# ---------------------------------------------------------------- model training (rows-only checks)


def _train_test(spark, d):
    enc = M.materialise(ML.encode(_gold(spark, d)), written_table_dir(spark, "features"))
    return ML.split(enc, "contract_id")


def _fit(train, *names):
    return ML.fit_models(train, grid={n: ML.GRID[n] for n in names or ML.GRID})


@register("ml_train_metrics", None, "ML-2/ML-3/ML-4")
def ml_train_metrics(spark, d):
    train, test = _train_test(spark, d)
    models = _fit(train)
    chosen = ML.choose_model(M.materialise(ML.score_all(models, test), written_table_dir(spark, "scored")), list(models))
    sizes = train.agg(F.count(F.lit(1)).alias("train_size")).crossJoin(test.agg(F.count(F.lit(1)).alias("test_size")))
    return chosen.crossJoin(sizes).withColumn("n_features", F.lit(len(ML.FEATURES)))


@register("ml_scores", None, "ML-8")
def ml_scores(spark, d):
    train, test = _train_test(spark, d)
    m = _fit(train, "logistic_regression")["logistic_regression"]
    return ML.score(m, test, "logistic_regression").select("contract_id", "target_label", "probability_default",
                                                           "predicted_label", "confidence")


@register("ml_save_run", None, "ML-7")
def ml_save_run(spark, d):
    train, test = _train_test(spark, d)
    root = written_table_dir(spark, "models")
    ML.save_run(spark, _fit(train, "logistic_regression")["logistic_regression"], "logistic_regression",
                {"train_size": train.count(), "test_size": test.count(), "n_features": len(ML.FEATURES)}, root)
    return ML.score(ML.latest_model(spark, root), test, "latest").select("contract_id", "predicted_label", "model")


@register("ml_feature_importance", None, "ML-6")
def ml_feature_importance(spark, d):
    train, _ = _train_test(spark, d)
    return spark.createDataFrame(ML.feature_importance(_fit(train, "random_forest")["random_forest"]), "feature string, importance double")


@register("ml_risk_type_scores", None, "ML-11/ML-12")
def ml_risk_type_scores(spark, d):
    t = R.AuditTables.from_catalog(Catalog(spark, d))
    off = R.off_hours_operations(t)
    events = (off.where("is_night").select(F.col("person_id").alias("subject_id"), F.lit("night_ops").alias("risk_type"))
              .unionByName(off.where("is_weekend").select(F.col("person_id").alias("subject_id"),
                                                          F.lit("weekend_ops").alias("risk_type"))))
    per = t.ledger.groupBy("person_id").agg(F.count(F.lit(1)).cast("double").alias("n_ops"),
                                            F.avg("trans_amount").alias("avg_amount"),
                                            F.max("trans_amount").alias("max_amount"))
    feats = per.join(t.persons.select("person_id", "balance", "deposit_base"), "person_id", "left").fillna(0.0)
    feats = M.materialise(feats, written_table_dir(spark, "features"))
    types = ML.risk_types_of(events)
    labelled = M.materialise(ML.risk_type_labels(feats, events, types), written_table_dir(spark, "labelled"))
    cols = ["n_ops", "avg_amount", "max_amount", "balance", "deposit_base"]
    forests, _ = ML.fit_risk_types(labelled, types, cols)
    return ML.type_forests.score_types(feats, forests, "person_id")


# ---------------------------------------------------------------- scoring with models that SQL can state
@register("ml_scores_fixed", "WITH gold AS (" + GOLD_SQL + """),
g AS (SELECT contract_id, CAST(target_label AS INTEGER) AS target_label, 1 / (1 + exp((coalesce(credit_score, 0) - 650) / 50.0)) AS p FROM gold
      WHERE CAST('0x' || substr(md5(contract_id || '-42'), 1, 8) AS BIGINT) % 100 < 20)
SELECT contract_id, target_label, round(p, 6) AS probability_default, CAST(p > 0.5 AS INTEGER) AS predicted_label,
       round(greatest(p, 1 - p), 6) AS confidence, 'latest' AS model FROM g""", "ML-7/ML-8")
def ml_scores_fixed(spark, d):
    """A model of one formula, saved as the newer of two runs, loaded as the latest and applied to the test rows."""
    root = written_table_dir(spark, "models")
    for at in (500, 650):
        formula = SQLTransformer(statement=f"SELECT *, 1 - p AS q, CAST(p > 0.5 AS DOUBLE) AS prediction FROM "
                                           f"(SELECT *, 1 / (1 + exp((credit_score - {at}) / 50D)) AS p FROM __THIS__)")
        ML.save_run(spark, PipelineModel([formula, VectorAssembler(inputCols=["q", "p"], outputCol="probability")]), "formula", {"at": at}, root)
    scored = ML.score(ML.latest_model(spark, root), _train_test(spark, d)[1], "latest")
    return scored.select("contract_id", F.col("target_label").cast("int").alias("target_label"), F.round("probability_default", 6).alias("probability_default"),
                         "predicted_label", F.round("confidence", 6).alias("confidence"), "model")


_EDGES = {"n_ops": [float(x) for x in range(5, 105, 5)], "max_amount": [float(x) for x in range(20, 520, 20)]}


@register("ml_risk_type_tree", ALL + ",\noffh AS (" + RULE_SQL["off_hours_operations"] + "),\n" + f"""
per AS (SELECT person_id, CAST(count(*) AS DOUBLE) AS n_ops, max(trans_amount) AS max_amount FROM ledger GROUP BY person_id),
pairs AS (SELECT person_id, 'many_nights' AS kind FROM offh GROUP BY person_id HAVING count_if(is_night) >= 26
          UNION SELECT person_id, 'many_weekends' FROM offh GROUP BY person_id HAVING count_if(is_weekend) >= 18),
lab AS (SELECT per.*, k.kind, (p.person_id IS NOT NULL)::INT AS y FROM per CROSS JOIN (SELECT DISTINCT kind FROM pairs) k
        LEFT JOIN pairs p ON p.person_id = per.person_id AND p.kind = k.kind),
w AS (SELECT kind, count(*) / (2.0 * count(*) FILTER (WHERE y = 0)) AS w0, count(*) / (2.0 * sum(y)) AS w1, count(*) / 2.0 AS half FROM lab
      GROUP BY kind HAVING sum(y) >= 5 AND count(*) FILTER (WHERE y = 0) > 0),
cut AS (SELECT 0 AS f, unnest({_EDGES['n_ops']}) AS e UNION ALL SELECT 1, unnest({_EDGES['max_amount']})),
side AS (SELECT w.kind, f, e, half, w0 * count(*) FILTER (WHERE y = 0 AND CASE f WHEN 0 THEN n_ops ELSE max_amount END <= e) AS l0,
           w1 * count(*) FILTER (WHERE y = 1 AND CASE f WHEN 0 THEN n_ops ELSE max_amount END <= e) AS l1
         FROM lab JOIN w USING (kind) CROSS JOIN cut GROUP BY w.kind, f, e, half, w0, w1),
gain AS (SELECT *, half - l0 AS r0, half - l1 AS r1 FROM side),
best AS (SELECT *, round((2 * half - half) - (l0 + l1 - (l0 * l0 + l1 * l1) / (l0 + l1)) - (r0 + r1 - (r0 * r0 + r1 * r1) / (r0 + r1)), 9) AS gain FROM gain
         WHERE l0 + l1 > 1e-9 AND r0 + r1 > 1e-9),
tree AS (SELECT * FROM best WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY gain DESC, f, e) = 1),
s AS (SELECT person_id, lab.kind AS risk_type, CASE WHEN CASE f WHEN 0 THEN n_ops ELSE max_amount END <= e THEN l1 / (l0 + l1) ELSE r1 / (r0 + r1) END AS p
      FROM lab JOIN tree USING (kind))
SELECT person_id, risk_type, round(p * 100, 1) AS score FROM s WHERE p > 0.5 + 1e-9""", "ML-11/ML-12")
def ml_risk_type_tree(spark, d):
    """One split per type, grown over given edges from all rows: the trainer and scorer of all types with an answer SQL can find."""
    t = R.AuditTables.from_catalog(Catalog(spark, d))
    off = R.off_hours_operations(t).groupBy(F.col("person_id").alias("subject_id")).agg(
        F.count_if("is_night").alias("nights"), F.count_if("is_weekend").alias("weekends"))
    events = (off.where("nights >= 26").select("subject_id", F.lit("many_nights").alias("risk_type"))
              .unionByName(off.where("weekends >= 18").select("subject_id", F.lit("many_weekends").alias("risk_type"))))
    per = t.ledger.groupBy("person_id").agg(F.count(F.lit(1)).cast("double").alias("n_ops"), F.max("trans_amount").alias("max_amount"))
    types = ML.risk_types_of(events)
    labelled = M.materialise(ML.risk_type_labels(per, events, types), written_table_dir(spark, "labelled"))
    forests = ML.type_forests.fit_type_forests(labelled, "person_id", list(_EDGES), types, trees=1, depth=1, subset=2, edges=list(_EDGES.values()), bagged=False)
    return ML.type_forests.score_types(labelled, forests, "person_id", 0.5 + 1e-9)
