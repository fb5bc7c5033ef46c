from __future__ import annotations

import threading
import time

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from conftest import SMALL
from matchlens.operators import evaluate as E
from matchlens.operators import scoring as S
from matchlens.operators import training as TR
from matchlens.operators.features import engineer_features
from matchlens.plans import catalog, workflow
from matchlens.plans.report import report_text
from matchlens.schema import FEATURES, ROLES
from matchlens.sources import match_views as mv
from matchlens.sources import model_store as MS

SETTINGS = {
    "logistic": [{"C": 1.0, "max_iter": 20}, {"C": 1e-4, "max_iter": 20, "penalty": "l1"}],
    "xgboost": [{"n_estimators": 5, "max_depth": 3, "learning_rate": 0.2}],
    "neural_network": [{"n_neurons": 8, "n_hidden": 1, "epochs": 10}],
}


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    prepared = TR.prepare_training(engineer_features(mv.player_games(spark, SMALL)))
    fits = TR.train_roles(prepared, list(SETTINGS), SETTINGS.get, roles=["Top", "ADC"])
    store = str(tmp_path_factory.mktemp("models"))
    MS.save_models(fits, store)
    return prepared, fits, store


def test_grids_and_seeded_draws():
    assert len(TR.parameter_grid("logistic")) == 80
    assert len(TR.parameter_grid("random_forest")) == 72
    assert len(TR.parameter_grid("xgboost")) == 324
    assert len(TR.parameter_grid("neural_network")) == 36
    draw = TR.draw_parameters("xgboost")
    assert len(draw) == 20 and draw == TR.draw_parameters("xgboost")
    assert len({str(p) for p in draw}) == 20
    assert len(TR.draw_parameters("neural_network")) == 10
    assert draw != TR.draw_parameters("xgboost", seed=1)


@pytest.mark.parametrize("layers, total", [
    ([11, 80, 1], 1041), ([11, 30, 30, 1], 1321), ([11, 50, 1], 651), ([11, 70, 1], 911)])
def test_dense_net_sizes(layers, total):
    assert TR.dense_parameters(layers) == total


def test_search_picks_the_better_setting_and_models_learn(trained):
    prepared, fits, _ = trained
    logistic = [f for f in fits if f.family == "logistic"]
    assert len(fits) == 6 and all(f.params["C"] == 1.0 for f in logistic)
    metrics = E.all_metrics(TR.score_fits(fits, prepared.where("is_test"))).collect()
    auc = {(r.role, r.model): r.auc_roc for r in metrics}
    assert auc["Top", "logistic"] > 0.5 and auc["Top", "xgboost"] > 0.5


def test_reloaded_models_score_the_same(spark, trained):
    prepared, fits, store = trained
    again = MS.load_all(spark, store)
    assert set(again) == {"Top", "ADC"} and set(again["Top"]) == set(SETTINGS)
    rows = prepared.where("is_test AND role = 'Top'")
    for fit in (f for f in fits if f.role == "Top"):
        a = S.positive_probability(fit.model.transform(rows), "p").select("row_key", "p")
        b = S.positive_probability(again["Top"][fit.family].transform(rows), "q")
        worst = a.join(b.select("row_key", "q"), "row_key").agg(F.max(F.abs(F.col("p") - F.col("q"))))
        assert worst.first()[0] == 0.0


def test_scaler_travels_with_the_model(trained):
    prepared, fits, _ = trained
    fit = next(f for f in fits if f.family == "logistic")
    train = prepared.where((F.col("role") == fit.role) & ~F.col("is_test"))
    scaled = fit.model.transform(train).agg(
        F.avg("__z_gpm").alias("m"), F.stddev_pop("__z_gpm").alias("s")).first()
    assert scaled.m == pytest.approx(0.0, abs=1e-9) and scaled.s == pytest.approx(1.0)


def test_missing_model_and_fallback(spark, trained):
    prepared, fits, store = trained
    with pytest.raises(FileNotFoundError):
        MS.load_model(spark, store, "Mid", "xgboost")
    metrics = spark.createDataFrame(
        [("Top", "logistic", 0.9, 0.1), ("Top", "xgboost", 0.8, 0.9)],
        "role string, model string, auc_roc double, accuracy double")
    best = MS.load_best(spark, store, metrics)
    assert {r: n for r, (n, _) in best.items()} == {"Top": "logistic", "ADC": "xgboost"}


def test_batch_and_single_scoring_agree(spark, trained):
    _, fits, store = trained
    model = MS.load_model(spark, store, "ADC", "xgboost")
    stats = {"kde": 3.0, "gpm": 300.0, "gd_15": None}
    one = S.predict_one(spark, stats, "adc", "xgboost", model)
    assert one["role"] == "ADC" and one["skill_rating"] == one["win_probability"]
    assert one["win_prediction"] == int(one["win_probability"] > 0.5)
    assert S.quick_predict(spark, stats, "ADC", "xgboost", model) == one["skill_rating"]
    players = spark.createDataFrame(
        [("x", "aDc", 3.0, 300.0), ("y", "Coach", 1.0, 1.0)],
        "id string, Role string, kde double, gpm double")
    got = S.batch_predict(players, {"ADC": ("xgboost", model)}, "id", "Role").collect()
    assert {(r.player_id, r.skill_rating) for r in got} == {("x", one["skill_rating"]), ("y", None)}
    with pytest.raises(ValueError, match="no model available"):
        S.predict_one(spark, stats, "coach", "xgboost", model)


def test_a_failing_role_is_left_out(trained):
    prepared, _, _ = trained

    def settings(family):
        return [{"n_neurons": 0 if family == "neural_network" else 5, "max_iter": 5}]

    failures = []
    fits = TR.train_roles(
        prepared, ["logistic", "neural_network"], settings, roles=["Mid", "Nobody"], failures=failures)
    assert [(f.role, f.family) for f in fits] == [("Mid", "logistic")]
    assert [f[:2] for f in failures] == [("Mid", "neural_network")]
    rows = TR.failure_rows(prepared.sparkSession, failures).collect()
    assert rows[0].family == "neural_network" and rows[0].error
    with pytest.raises(RuntimeError, match="no model could be fitted"):
        TR.train_roles(prepared, ["neural_network"], settings, roles=["Mid"])


def test_specs_list_net_sizes(spark, trained):
    _, fits, _ = trained
    specs = TR.model_specs(spark, fits)
    got = {(r.family, r.role, r.setting): r.value for r in specs.collect()}
    assert got["neural_network", "Top", "layers"] == "11-8-2"
    assert got["neural_network", "Top", "total_params"] == str(TR.dense_parameters([11, 8, 2]))


def test_constant_feature_scales_by_one(spark):
    rows = [("Top", *[1.0] * len(FEATURES)), ("Top", *[1.0] * len(FEATURES))]
    df = spark.createDataFrame(rows, "role string, " + ", ".join(f"{f} double" for f in FEATURES))
    got = S.standardise(df, S.scaler_stats(df)).first()
    assert all(got[f"z_{f}"] == 0.0 for f in FEATURES)


def test_run_with_and_without_training(spark, tmp_path):
    calls = []

    def collect():
        calls.append(1)
        return mv.player_games(spark, SMALL)

    plain = workflow.run(spark, collect, str(tmp_path), skip={"train"})
    assert plain.metrics is None and plain.shap is None
    sections = {r.section for r in plain.report.collect()}
    assert sections == {"dataset", "roles"}
    assert {"pressure_slopes", "pressure_tiers", "report"} <= set(plain.frames)
    full = workflow.run(
        spark, collect, str(tmp_path), families=["logistic"], skip={"pressure"},
        settings=lambda f: SETTINGS[f][:1], n_permutations=1, background=3)
    assert len(calls) == 1  # collected rows are reused
    assert full.metrics.count() == len(ROLES)
    assert full.shap.groupBy("role").count().where("count > 100").count() == 0
    assert {"roc_curve", "best_model", "importance", "dependence", "model_specs"} <= set(full.frames)
    assert full.frames["failures"].count() == 0 and "pressure_slopes" not in full.frames
    text = report_text(full.report)
    assert "# models" in text and "Top: logistic" in text


def test_search_works_out_the_rows_once_and_scores_as_cross_validation(spark):
    rows = [(f"r{i}", float(i % 7), float((i * i) % 11), int((i * 5) % 13 > 5), i % 3) for i in range(240)]
    worked_out = spark.sparkContext.accumulator(0)

    def counted(x: float) -> float:
        worked_out.add(1)
        return x

    plain = spark.createDataFrame(rows, "row_key string, a double, b double, win int, fold int").repartition(3, "row_key")
    train = plain.withColumn("a", F.udf(counted, "double")("a"))
    settings = [{"n_estimators": 3, "max_depth": 2}, {"n_estimators": 5, "max_depth": 4}]
    fit = TR.fit_family(train, "Top", "random_forest", settings, features=["a", "b"])
    assert worked_out.value == len(rows) and fit.n_train == len(rows)

    inputs = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(plain).select("features", "win", "fold")
    search, estimators = Pipeline(stages=[]), [TR.classifier("random_forest", p, 160, 2) for p in settings]
    whole = CrossValidator(
        estimator=search, estimatorParamMaps=[{search.stages: [e]} for e in estimators], numFolds=3, foldCol="fold",
        evaluator=BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="win", numBins=0),
    ).fit(inputs)
    assert [auc for _, auc in fit.searched] == pytest.approx(whole.avgMetrics, abs=1e-12)
    assert fit.cv_auc == max(auc for _, auc in fit.searched)
    assert fit.model.stages[-1].toDebugString.split("\n", 1)[1] == whole.bestModel.stages[0].toDebugString.split("\n", 1)[1]
    with pytest.raises(ValueError, match="folds 0 to 2"):
        TR.fit_family(plain.where("fold < 2"), "Top", "random_forest", settings, features=["a", "b"])


def test_gbt_and_net_search_the_whole_draw(spark, monkeypatch):
    asked = {}

    def searched(prepared, families, settings, **_):
        asked.update({f: settings(f) for f in families})
        raise InterruptedError

    monkeypatch.setattr(catalog.TR, "prepare_training", lambda rows: None)
    monkeypatch.setattr(catalog.TR, "train_roles", searched)
    monkeypatch.setattr(catalog, "_features", lambda spark, d: None)
    for query in ("train_gbt", "train_mlp"):
        with pytest.raises(InterruptedError):
            catalog.QUERIES[query](spark, SMALL)
    assert asked == {f: TR.draw_parameters(f) for f in ("xgboost", "neural_network")}
    assert {f: len(p) for f, p in asked.items()} == {"xgboost": 20, "neural_network": 10}


@pytest.mark.parametrize("rows, most", [(1000, 4), (400, 2), (100, 1)])
def test_large_fits_do_not_run_at_the_same_time(spark, monkeypatch, rows, most):
    running, seen, lock = [], [], threading.Lock()

    def fit(train, role, family, *_, **__):
        with lock:
            running.append(role)
            seen.append(len(running))
        time.sleep(0.3)
        with lock:
            running.remove(role)

    monkeypatch.setattr(TR, "fit_family", fit)
    monkeypatch.setattr(TR, "ROWS_AT_ONCE", rows)
    prepared = spark.range(1000).selectExpr("id", "element_at(array('Top', 'Mid', 'ADC', 'Support', 'Jungle'), int(id % 5) + 1) AS role", "false AS is_test")
    TR.train_roles(prepared, ["logistic"])
    assert len(seen) == 5 and max(seen) == most
    assert [TR.at_once(2, n) for n in (1, rows // 2, rows // 2 + 1, 10 * rows, 0)] == [2, 2, 1, 1, 2]
