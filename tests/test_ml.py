"""ML smoke tests: shared encoding, training with CV, scoring, threshold, events."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fundscope.plans import medallion as M
from fundscope.plans import ml as ML
from fundscope.sources.tables import Catalog
from fundscope.streaming import jobs as J


def test_train_and_score(spark, small_dir):
    enc = ML.encode(M.build_gold(Catalog(spark, small_dir)))
    assert set(ML.FEATURES) <= set(enc.columns)
    assert enc.where(F.greatest(*[F.isnan(c).cast("int") for c in ML.FEATURES]) == 1).count() == 0
    train, test = ML.split(enc, "contract_id")
    assert train.count() + test.count() == enc.count()
    models = ML.fit_models(train, grid={"logistic_regression": {"C": (1,)}}, folds=2)
    s = ML.score(models["logistic_regression"], test, "lr")
    assert s.where((F.col("probability_default") < 0) | (F.col("probability_default") > 1)).count() == 0
    rep = {r["class"]: r for r in ML.classification_report(s).collect()}
    assert rep[0]["support"] + rep[1]["support"] == test.count()
    th = ML.best_threshold(s).first()
    assert 0.0 <= th["threshold"] <= 1.0
    assert len(ML.feature_importance(models["logistic_regression"])) == 10


def test_events_dedupe_and_close(spark):
    scored = spark.createDataFrame([(1, 10, 70), (1, 11, 80), (2, 12, 40), (3, 13, 90)],
                                   "person_id long, loan_id long, score int")
    existing = spark.createDataFrame([("3", "loan_default", "Pending")], "subject_id string, risk_type string, status string")
    new = {(r["subject_id"], r["evidence"]) for r in ML.new_risk_events(scored, existing, created_at="2024-01-01").collect()}
    assert new == {("1", "loan_id=11")}
    ev = spark.createDataFrame([
        ("e1", "1", "t", "Pending", dt.datetime(2024, 1, 1), None, None, None, None),
        ("e2", "1", "t", "Pending", dt.datetime(2024, 2, 1), None, None, None, None),
        ("e3", "1", "t", "Closed", dt.datetime(2024, 3, 1), "x", None, None, None)],
        "event_id string, subject_id string, risk_type string, status string, created_at timestamp_ntz, "
        "verdict string, note string, handler string, handled_at timestamp_ntz")
    fb = spark.createDataFrame([("1", "t", "ok", "n", "h")], "subject_id string, risk_type string, verdict string, "
                                                             "note string, handler string")
    out = {r["event_id"]: r["status"] for r in ML.close_with_feedback(ev, fb, "2024-04-01 00:00:00").collect()}
    assert out == {"e1": "Pending", "e2": "Closed", "e3": "Closed"}


def test_dedupe_stream(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    spark.createDataFrame([("1", "t", dt.datetime(2024, 1, 1)), ("1", "t", dt.datetime(2024, 1, 1, 1)),
                           ("2", "t", dt.datetime(2024, 1, 1))], "subject_id string, risk_type string, "
                                                                 "created_at timestamp_ntz") \
        .write.parquet(str(src / "b0"))
    schema = "subject_id string, risk_type string, created_at timestamp_ntz"
    s = spark.readStream.schema(schema).parquet(str(src / "b0"))
    q = J.dedupe_events_stream(s).writeStream.format("memory").queryName("dd").trigger(availableNow=True) \
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.table("dd").count() == 2


def test_save_run_and_state(spark, small_dir, tmp_path):
    from fundscope.sources import sync as SY
    enc = ML.encode(M.build_gold(Catalog(spark, small_dir)))
    train, _ = ML.split(enc, "contract_id")
    m = ML.fit_models(train, grid={"logistic_regression": {"C": (1,)}}, folds=2)["logistic_regression"]
    path = ML.save_run(spark, m, "logistic_regression", {"f1": "0.5"}, str(tmp_path))
    from pyspark.ml import PipelineModel
    assert PipelineModel.load(path).uid == ML.latest_model(spark, str(tmp_path)).uid
    runs = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert runs[0]["m"]["model_type"] == "logistic_regression" and runs[0]["m"]["f1"] == "0.5"
    state = spark.createDataFrame([("a", "ts", "1"), ("b", "ts", "5")], "table_name string, column_name string, "
                                                                          "last_value string")
    cur = spark.createDataFrame([("a", "ts", "3"), ("c", "id", "9"), ("b", "ts", None)],
                                "table_name string, column_name string, last_value string")
    got = {r["table_name"]: r["last_value"] for r in SY.advance_state(state, cur).collect()}
    assert got == {"a": "3", "b": "5", "c": "9"}


@pytest.mark.parametrize("name,kinds", [("ml_train_metrics", ML.GRID), ("ml_scores", ["logistic_regression"]),
                                        ("ml_save_run", ["logistic_regression"]), ("ml_feature_importance", ["random_forest"])])
def test_registered_queries_search_the_whole_space(spark, small_dir, monkeypatch, name, kinds):
    from fundscope.plans.registry import entries

    class Asked(Exception):
        pass

    def fit_models(train, grid=ML.GRID, **_):
        raise Asked(grid)

    monkeypatch.setattr(ML, "fit_models", fit_models)
    with pytest.raises(Asked) as asked:
        entries()[name].fn(spark, small_dir)
    assert asked.value.args[0] == {k: ML.GRID[k] for k in kinds}
