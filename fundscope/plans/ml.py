"""Features, training, scoring and risk-event bookkeeping with Spark ML.

One ``encode`` function feeds both training and scoring.  Model selection is a grid search over 3 folds
(F1 of the positive class) that reads smaller ensembles off larger ones; the boosted-tree
stand-in is GBT.  Threshold search counts equal scores first and takes prefix sums over
ranges of the distinct ones, so it is exact.  Risk events are appended with
in-batch dedupe plus an anti join against open events, all as joins and
aggregates.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..operators.stats import global_rank
from ..session import written_table_dir
from . import tree_search, type_forests
from .rules import AuditTables

# Category codes and defaults used by the feature encoding.
GENDER_CODES = {"M": 0, "F": 1, "U": 2}
GENDER_DEFAULT = 2
OCCUPATION_CODES = {"civil_servant": 0, "teacher": 1, "doctor": 2, "engineer": 3, "worker": 4,
                    "business_owner": 5, "freelancer": 6}
OCCUPATION_DEFAULT = 4
DTI_CODES = {"low_risk": 0, "medium_risk": 1, "high_risk": 2}
DTI_DEFAULT = 0
AGE_CODES = {"young": 0, "prime": 1, "mature": 2, "senior": 3}
AGE_DEFAULT = 1
INCOME_CODES = {"low_income": 0, "middle_income": 1, "high_income": 2}
INCOME_DEFAULT = 1
DURATION_CODES = {"short_term": 0, "long_term": 1, "ultra_long": 2}
DURATION_DEFAULT = 0
VALID_GENDERS = ("M", "F")
VALID_OCCUPATIONS = ("civil_servant", "teacher", "doctor", "engineer", "business_owner", "freelancer", "worker")



def _code(col: str, codes: dict, default: int) -> Column:
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(col)], F.lit(default)).cast("int")


# ---------------------------------------------------------------- FE-1..3
def encode(gold: DataFrame, id_col: str = "contract_id", label: str | None = "target_label") -> DataFrame:
    """Numeric feature frame from the gold table: leakage columns dropped,
    categories coded, ratio/interaction features derived, NULL/NaN -> 0.
    Keeps ``id_col`` (not a feature) so scores can be joined back."""
    d = lambda c: F.col(c).cast("double")
    amt, inc = d("loan_amount"), d("monthly_income")
    dti = safe_divide(amt, inc + 1.0)
    score_norm = (d("credit_score") - 300) / 550
    payment = safe_divide(amt, d("loan_period_months") + 1)
    occ = _code("occupation", OCCUPATION_CODES, OCCUPATION_DEFAULT)
    feats = {
        "age": d("age"), "gender": _code("gender", GENDER_CODES, GENDER_DEFAULT).cast("double"),
        "monthly_income": inc, "occupation": occ.cast("double"), "city_tier": d("city_tier"),
        "credit_score": d("credit_score"), "loan_amount": amt, "loan_period_months": d("loan_period_months"),
        "dti_category": _code("dti_category", DTI_CODES, DTI_DEFAULT).cast("double"),
        "age_group": _code("age_group", AGE_CODES, AGE_DEFAULT).cast("double"),
        "income_level": _code("income_level", INCOME_CODES, INCOME_DEFAULT).cast("double"),
        "loan_duration_type": _code("loan_duration_type", DURATION_CODES, DURATION_DEFAULT).cast("double"),
        "dti_ratio": dti, "age_dti_interaction": d("age") * dti, "log_income": F.log1p(inc),
        "income_loan_ratio": safe_divide(inc, amt + 1), "credit_score_norm": score_norm,
        "dti_credit_risk": dti * (1 - score_norm), "monthly_payment": payment,
        "payment_income_ratio": safe_divide(payment, inc + 1), "age_credit_interaction": d("age") * score_norm,
        "occupation_risk": occ / 6.0, "city_risk": (4 - d("city_tier")) / 3.0,
    }
    cols = [F.col(id_col)] + [F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0)).alias(k)
                              for k, v in feats.items()]
    if label:
        cols.append(F.col(label).cast("int").alias(label))
    return gold.select(*cols)


FEATURES = ("age", "gender", "monthly_income", "occupation", "city_tier", "credit_score", "loan_amount",
            "loan_period_months", "dti_category", "age_group", "income_level", "loan_duration_type", "dti_ratio",
            "age_dti_interaction", "log_income", "income_loan_ratio", "credit_score_norm", "dti_credit_risk",
            "monthly_payment", "payment_income_ratio", "age_credit_interaction", "occupation_risk", "city_risk")


# ---------------------------------------------------------------- FE-4 behaviour
def behaviour_features(t: AuditTables, risk_events: DataFrame, active_status: str = "disbursed",
                       normal_status: str = "normal") -> DataFrame:
    """Per active loan: balance coverage of one instalment, abnormal deposit
    status (NULL counts as abnormal), overdue records and prior risk events.
    Counts are aggregated per key before the left joins."""
    loans = t.loans.where(F.col("status") == active_status)
    p = t.persons.select("person_id", "balance", "deposit_base", F.col("status").alias("deposit_status"))
    od = t.overdues.groupBy("loan_id").agg(F.count(F.lit(1)).alias("overdue_count"))
    ev = risk_events.groupBy(F.col("subject_id").alias("person_id")).agg(F.count(F.lit(1)).alias("risk_event_count"))
    j = loans.join(p, "person_id", "left").join(od, "loan_id", "left").join(ev, "person_id", "left")
    term = F.coalesce(F.nullif(F.col("term_months"), F.lit(0)), F.lit(120))
    instalment = F.col("amount") / term
    coverage = F.when(instalment > 0, F.round((F.col("balance") + F.col("deposit_base")) / instalment, 2)) \
        .otherwise(F.lit(999.0))
    return j.select("loan_id", "person_id", "amount", term.alias("term_months"), coverage.alias("balance_coverage"),
                    (~F.col("deposit_status").eqNullSafe(normal_status)).cast("int").alias("deposit_abnormal"),
                    F.coalesce(F.col("overdue_count"), F.lit(0)).alias("overdue_count"),
                    F.coalesce(F.col("risk_event_count"), F.lit(0)).alias("risk_event_count"))


# ---------------------------------------------------------------- ML-13 rule score
def rule_score(behaviour: DataFrame) -> DataFrame:
    """Fallback score: 40 abnormal deposits + 30 any overdue + 25 coverage < 1
    (or 15 when < 3), clamped to 0..100."""
    cov = F.col("balance_coverage")
    s = (F.col("deposit_abnormal") * 40 + F.when(F.col("overdue_count") > 0, 30).otherwise(0)
         + F.when(cov < 1, 25).when(cov < 3, 15).otherwise(0))
    return behaviour.withColumn("rule_score", F.least(F.lit(100), F.greatest(F.lit(0), s)).cast("int"))


# ---------------------------------------------------------------- ML-9/10
def band(df: DataFrame, prob_col: str = "probability_default") -> DataFrame:
    """Risk level and decision from the default probability, plus reasons from
    the application's ratios (annual DTI, credit score, income, term)."""
    p = F.col(prob_col)
    annual_dti = safe_divide(F.col("loan_amount").cast("double"), F.col("monthly_income").cast("double") * 12)
    reasons = F.concat_ws(", ", F.when(annual_dti > 3, F.lit("very high DTI")).when(annual_dti > 2, F.lit("high DTI")),
                          F.when(F.col("credit_score") < 580, F.lit("very low credit score"))
                           .when(F.col("credit_score") < 650, F.lit("low credit score")),
                          F.when(F.col("monthly_income") < 5000, F.lit("low income")),
                          F.when(F.col("loan_period_months") > 240, F.lit("long term")))
    return df.select("*", F.when(p < 0.3, "low").when(p < 0.7, "medium").otherwise("high").alias("risk_level"),
                     F.when(p < 0.3, "approve").when(p < 0.7, "manual_review").otherwise("reject").alias("decision"),
                     reasons.alias("reasons"))


def validate_applications(df: DataFrame, occupations: Sequence[str] = VALID_OCCUPATIONS) -> DataFrame:
    """Adds ``is_valid`` and ``invalid_reasons`` (age 18-70, income > 0, tier 1-3,
    score 300-850, gender M/F, known occupation, positive amount and term)."""
    checks = {
        "age": F.col("age").between(18, 70), "monthly_income": F.col("monthly_income") > 0,
        "city_tier": F.col("city_tier").between(1, 3), "credit_score": F.col("credit_score").between(300, 850),
        "gender": F.col("gender").isin(*VALID_GENDERS), "occupation": F.col("occupation").isin(*occupations),
        "loan_amount": F.col("loan_amount") > 0, "loan_period_months": F.col("loan_period_months") > 0,
    }
    bad = [F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]
    reasons = F.concat_ws(",", *bad)
    return df.select("*", (reasons == "").alias("is_valid"), reasons.alias("invalid_reasons"))


# ---------------------------------------------------------------- ML-1 split
def hash_bucket(key: str, seed: int, buckets: int) -> Column:
    """A bucket by the key's MD5: the same on any cluster, and in any engine."""
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def split(df: DataFrame, key: str, test_pct: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split by a hash of the key (stable across runs
    and cluster sizes, unlike a random split of re-read data)."""
    b = hash_bucket(key, seed, 100)
    return df.where(b >= test_pct), df.where(b < test_pct)


def class_weights(df: DataFrame, label: str = "target_label", weight_col: str = "class_weight") -> DataFrame:
    """Balanced class weights n / (2 n_c) from a per-class count (2 rows) joined back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(total).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight_col))
    return df.join(F.broadcast(w), label, "left")


# ---------------------------------------------------------------- ML-2..8
# The search space.  C is the inverse of the regularisation of the summed loss; a depth without
# limit is the deepest that Spark grows.
GRID = {
    "logistic_regression": {"C": (0.1, 1, 10)},
    "random_forest": {"numTrees": (50, 100, 200), "maxDepth": (10, 20, 30)},
    "gbt": {"maxIter": (50, 100, 200), "maxDepth": (4, 6, 8), "stepSize": (0.01, 0.05, 0.1)},
}
RISK_TYPE_TREES = 100
#: Rows of a partition of the table that models are fitted on, at least, and its partitions for each core, at most: a fit is
#: hundreds of short jobs of a task a partition, all started by one driver.
FIT_PARTITION_ROWS, FIT_PARTITIONS = 50_000, 3


def fit_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of a table of so many rows that models are fitted on."""
    return max(1, min(rows // FIT_PARTITION_ROWS, FIT_PARTITIONS * spark.sparkContext.defaultParallelism))


def fit_models(train: DataFrame, label: str = "target_label", features: Sequence[str] = FEATURES,
               grid: Mapping[str, Mapping[str, Sequence]] = GRID, key: str = "contract_id", folds: int = 3,
               seed: int = 42, parallelism: int = 8, trials: str | None = None) -> dict:
    """Grid search with k-fold CV (F1 of class 1) per model type of ``grid``, with balanced
    class weights and folds by a hash of ``key``.  Returns {name: fitted PipelineModel}.

    Ensembles are fitted once per fold and read at every size of the grid (``tree_search``).  Finished fits are kept in the folder
    ``trials`` (by default one named by a hash of the rows and the settings) and not repeated by a later or restarted search.
    ``train`` is read once per fit: pass a written table, not a plan of joins."""
    found = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key, label, *features).cast("decimal(20,0)")).alias("h")).first()
    rows = found["n"]
    if trials is None:
        settings = json.dumps([str(found["h"]), rows, label, list(features), key, folds, seed])
        trials = f"{os.path.dirname(written_table_dir(train.sparkSession, 'trials'))}/trials-{hashlib.md5(settings.encode()).hexdigest()}"
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    weighted = assembler.transform(class_weights(train, label).select("*", hash_bucket(key, seed + 1, folds).alias("_fold")))
    path = written_table_dir(train.sparkSession, "folds")
    # few rows are few partitions: the time of a small fit is that of its many short jobs
    weighted.select(*features, "features", label, "class_weight", "_fold").coalesce(fit_partitions(train.sparkSession, rows)).write.parquet(path)
    data = train.sparkSession.read.parquet(path).coalesce(fit_partitions(train.sparkSession, rows))
    models = {}

    def fit(name: str, point: Mapping) -> None:
        models[name] = PipelineModel([assembler, tree_search.fitted(name, point, data, features, rows, label, seed)])

    tree_search.search(data, features, label, grid, rows, folds, seed, parallelism, trials, fit)
    return {name: models[name] for name in grid}


def score(model, df: DataFrame, name: str = "model") -> DataFrame:
    """Batch scoring: default probability, predicted label, confidence = max prob."""
    s = model.transform(df)
    prob = vector_to_array(F.col("probability"))
    return s.select(*df.columns, prob[1].alias("probability_default"), F.col("prediction").cast("int")
                    .alias("predicted_label"), F.array_max(prob).alias("confidence"), F.lit(name).alias("model"))


def score_all(models: Mapping[str, object], df: DataFrame) -> DataFrame:
    """One pass over ``df``: the default probability of each model as ``p_<name>`` and their mean as ``p_ensemble``."""
    out = df
    for name, model in models.items():
        keep = out.columns
        out = model.transform(out).select(*keep, vector_to_array(F.col("probability"))[1].alias(f"p_{name}"))
    return ensemble(out, [f"p_{n}" for n in models])


def ensemble(df: DataFrame, prob_cols: Sequence[str], name: str = "p_ensemble") -> DataFrame:
    """Soft voting: the mean of the models' default probabilities per row."""
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c) for c in prob_cols]) / len(prob_cols))


def choose_model(scored: DataFrame, names: Sequence[str], label: str = "target_label") -> DataFrame:
    """One row: the single model of best F1 at 0.5 (the first of equals), or ``ensemble`` if its F1 is better; then the
    threshold that maximises the chosen one's F1, and the report of class 1 at that threshold.

    ``scored`` has ``p_<name>`` columns, of ``ensemble`` too."""
    every = [*names, "ensemble"]
    y = F.col(label) == 1

    def f1(p: str) -> Column:  # 2 tp / (2 tp + fp + fn)
        hit, tp = F.col(p) >= 0.5, F.count_if((F.col(p) >= 0.5) & y)
        return F.coalesce(F.try_divide(2.0 * tp, F.count_if(hit) + F.count_if(y)), F.lit(0.0))

    f1s = scored.agg(*[f1(f"p_{n}").alias(n) for n in every]).first().asDict()
    best = max(names, key=lambda n: f1s[n])
    chosen = "ensemble" if f1s["ensemble"] > f1s[best] else best
    top = best_threshold(scored, f"p_{chosen}", label)
    at = scored.crossJoin(F.broadcast(top.select("threshold")))  # one row
    report = classification_report(at.withColumn("predicted_label", (F.col(f"p_{chosen}") >= F.col("threshold")).cast("int")), label)
    return report.where(F.col("class") == 1).crossJoin(F.broadcast(top.select("threshold"))).select(
        F.lit(chosen).alias("model"), F.round(F.lit(f1s[chosen]), 6).alias("f1_at_half"), "threshold", "f1", "precision", "recall",
        "accuracy", "support")


def classification_report(scored: DataFrame, label: str = "target_label", pred: str = "predicted_label") -> DataFrame:
    """Confusion counts and precision/recall/F1 per class, accuracy, support."""
    cm = scored.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))
    per = cm.groupBy().agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))
                                   .otherwise(0)).alias(f"n{a}{p}") for a in (0, 1) for p in (0, 1)])
    rows = []
    for c in (0, 1):
        o = 1 - c
        tp, fp, fn = F.col(f"n{c}{c}"), F.col(f"n{o}{c}"), F.col(f"n{c}{o}")
        prec = safe_divide(tp.cast("double"), (tp + fp).cast("double"))
        rec = safe_divide(tp.cast("double"), (tp + fn).cast("double"))
        f1 = safe_divide(2 * prec * rec, prec + rec)
        total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
        acc = safe_divide((F.col("n00") + F.col("n11")).cast("double"), total.cast("double"))
        rows.append(per.select(F.lit(c).alias("class"), tp.alias("true_pos"), fp.alias("false_pos"),
                               fn.alias("false_neg"), F.round(prec, 6).alias("precision"),
                               F.round(rec, 6).alias("recall"), F.round(f1, 6).alias("f1"),
                               F.round(acc, 6).alias("accuracy"), (tp + fn).alias("support")))
    return rows[0].unionByName(rows[1])


def best_threshold(scored: DataFrame, prob_col: str = "probability_default", label: str = "target_label") -> DataFrame:
    """The score that, as threshold (score >= threshold is class 1), maximises F1; the largest of equals.
    Equal scores are counted first; the counts below each score are prefix sums over ranges of the distinct scores."""
    per = scored.where(F.col(prob_col).isNotNull()).groupBy(F.col(prob_col).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    below = global_rank(per, [], ["threshold"], "_below", weight=F.col("n"))
    below = global_rank(below, [], ["threshold"], "_pos_below", weight=F.col("pos"))
    tot = per.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("_all_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    c = below.crossJoin(F.broadcast(tot))
    all_pos = F.col("_all_pos")
    tp, hit = all_pos - F.col("_pos_below"), F.col("_all") - F.col("_below")
    f1 = safe_divide(2.0 * tp, (hit + all_pos).cast("double"))
    c = c.select("threshold", F.round(safe_divide(tp.cast("double"), hit.cast("double")), 6).alias("precision"),
                 F.round(safe_divide(tp.cast("double"), all_pos.cast("double")), 6).alias("recall"), F.round(f1, 6).alias("f1"))
    return c.orderBy(F.col("f1").desc_nulls_last(), F.col("threshold").desc()).limit(1)


def feature_importance(model, features: Sequence[str] = FEATURES, top: int = 10) -> list[tuple[str, float]]:
    """Top features by importance (trees) or |coefficient| (linear); read from
    the fitted model's parameters (a vector of len(features))."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray()
    else:
        vals = [abs(x) for x in m.coefficients.toArray()]
    return sorted(zip(features, [float(v) for v in vals]), key=lambda x: -x[1])[:top]


def save_run(spark: SparkSession, model, model_type: str, metrics: dict, root: str) -> str:
    """Versioned model save, then one run row appended to ``root/runs``: the run that is the latest is known from its
    row, so a crash in between leaves the one before it the latest.  Versions rise with time and never collide."""
    import time
    import uuid
    version = f"{time.strftime('%Y%m%d_%H%M%S', time.gmtime())}_{time.time_ns() % 10**9:09d}_{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/models/{model_type}_{version}"
    model.write().save(path)
    row = dict(metrics, model_type=model_type, model_path=path, version=version)
    run = spark.createDataFrame([json.dumps(row)], "string").select(F.from_json("value", "map<string,string>").alias("m"))
    run.coalesce(1).write.mode("append").parquet(os.path.join(root, "runs"))
    return path


def latest_model(spark: SparkSession, root: str) -> PipelineModel:
    """The model of the newest run."""
    runs = spark.read.schema("m map<string,string>").parquet(os.path.join(root, "runs"))
    return PipelineModel.load(runs.agg(F.max_by(F.col("m.model_path"), F.col("m.version")).alias("p")).first()["p"])


# ---------------------------------------------------------------- ML-11/12 per risk type
def risk_type_labels(features: DataFrame, events: DataFrame, risk_types: Sequence[str],
                     id_col: str = "person_id") -> DataFrame:
    """One 0/1 label column per listed risk type (subject has an event of that
    type), from a join on distinct (subject, type).  The types are passed in, so
    the pivot needs no value-discovery job."""
    pairs = events.select(F.col("subject_id").alias(id_col), "risk_type").distinct()
    wide = pairs.groupBy(id_col).pivot("risk_type", list(risk_types)).agg(F.lit(1))
    return features.join(wide, id_col, "left").fillna(0, subset=list(risk_types))


def risk_types_of(events: DataFrame) -> list[str]:
    """The risk types that occur, by name: a code list, one row per code."""
    return [r[0] for r in events.select("risk_type").where(F.col("risk_type").isNotNull()).distinct().orderBy("risk_type").collect()]


def fit_risk_types(labelled: DataFrame, risk_types: Sequence[str], features: Sequence[str], min_pos: int = 5,
                   seed: int = 42, id_col: str = "person_id", trees: int = RISK_TYPE_TREES) -> tuple[type_forests.TypeForests, dict]:
    """(forests of all types, {type: accuracy}), trained on 70 % of the rows by a hash of the id and measured on the others; types
    with fewer than ``min_pos`` positives are skipped."""
    enough = labelled.agg(*[F.sum(F.col(f"`{t}`")).alias(f"n{i}") for i, t in enumerate(risk_types)]).first()
    kept = [t for i, t in enumerate(risk_types) if (enough[f"n{i}"] or 0) >= min_pos]
    train, test = split(labelled, id_col, 30, seed)
    model = type_forests.fit_type_forests(train, id_col, features, kept, trees, min_pos=1)
    return model, type_forests.type_accuracy(test, model)


# ---------------------------------------------------------------- ML-14/15 events
def new_risk_events(scored: DataFrame, existing: DataFrame, min_score: int = 50, risk_type: str = "loan_default",
                    created_at=None) -> DataFrame:
    """Events to append: score >= ``min_score``; one per (subject, type) in the
    batch (highest score, then lowest loan id); none where an open (Pending)
    event already exists."""
    cand = scored.where(F.col("score") >= min_score).select(
        F.col("person_id").cast("string").alias("subject_id"), F.lit(risk_type).alias("risk_type"), "score", "loan_id")
    best = cand.groupBy("subject_id", "risk_type").agg(
        F.max_by(F.struct("score", "loan_id"), F.struct(F.col("score"), -F.col("loan_id"))).alias("b"))
    open_ev = existing.where(F.col("status") == "Pending").select("subject_id", "risk_type").distinct()
    fresh = best.join(open_ev, ["subject_id", "risk_type"], "left_anti")
    ts = F.lit(created_at).cast("timestamp_ntz") if created_at else F.localtimestamp()
    return fresh.select("subject_id", F.lit("person").alias("subject_type"), "risk_type",
                        F.col("b.score").cast("int").alias("score"),
                        F.concat(F.lit("loan_id="), F.col("b.loan_id").cast("string")).alias("evidence"),
                        F.lit("Pending").alias("status"), ts.alias("created_at"))


def close_with_feedback(events: DataFrame, feedback: DataFrame, handled_at=None) -> DataFrame:
    """Apply feedback: the newest non-closed event of each (subject, type) gets
    status Closed with verdict, note, handler and time; other rows unchanged.
    The newest open event per key is found with an aggregate (``max_by``), not
    a per-key sort."""
    open_ev = events.where(F.col("status") != "Closed")
    newest = open_ev.groupBy("subject_id", "risk_type").agg(
        F.max_by("event_id", F.struct("created_at", "event_id")).alias("event_id"))
    fb = feedback.join(newest, ["subject_id", "risk_type"]).select(
        "event_id", F.col("verdict").alias("_v"), F.col("note").alias("_n"), F.col("handler").alias("_h"))
    j = events.join(fb, "event_id", "left")
    hit = F.col("_v").isNotNull()
    ts = F.lit(handled_at).cast("timestamp_ntz") if handled_at else F.localtimestamp()
    return j.select(*[c for c in events.columns if c not in ("status", "verdict", "note", "handler", "handled_at")],
                    F.when(hit, F.lit("Closed")).otherwise(F.col("status")).alias("status"),
                    F.when(hit, F.col("_v")).otherwise(F.col("verdict")).alias("verdict"),
                    F.when(hit, F.col("_n")).otherwise(F.col("note")).alias("note"),
                    F.when(hit, F.col("_h")).otherwise(F.col("handler")).alias("handler"),
                    F.when(hit, ts).otherwise(F.col("handled_at")).alias("handled_at"))
