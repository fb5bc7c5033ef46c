from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from matchlens.operators import evaluate as E
from matchlens.operators import split as SP

SCHEMA = "role string, model string, label int, prediction int, probability double"


def scored(spark, pairs, role="Top", model="xgboost"):
    rows = [(role, model, y, int(p > 0.5), float(p)) for y, p in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def pairwise_auc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


RNG = random.Random(11)
TIED = [(RNG.randint(0, 1), RNG.randint(0, 10) / 10) for _ in range(200)]


@pytest.mark.parametrize("buckets", [1, 2, 5])
def test_auc_is_the_pairwise_share(spark, buckets):
    got = E.roc_auc(scored(spark, TIED), buckets=buckets).first().auc_roc
    assert got == pytest.approx(pairwise_auc(TIED), abs=1e-12)


def test_auc_of_equal_perfect_and_mirrored_scores(spark):
    equal = [(1, 0.3), (0, 0.3), (1, 0.3)]
    perfect = [(0, 0.1), (0, 0.2), (1, 0.8)]
    assert E.roc_auc(scored(spark, equal)).first().auc_roc == 0.5
    assert E.roc_auc(scored(spark, perfect)).first().auc_roc == 1.0
    mirrored = E.roc_auc(scored(spark, [(y, 1 - p) for y, p in TIED])).first().auc_roc
    assert mirrored == pytest.approx(1 - pairwise_auc(TIED), abs=1e-12)


def test_one_class_has_no_auc_but_other_metrics(spark):
    row = E.all_metrics(scored(spark, [(1, 0.9), (1, 0.2)])).first()
    assert row.auc_roc is None
    assert (row.accuracy, row.precision, row.recall) == (0.5, 1.0, 0.5)


@pytest.mark.parametrize("drop", [True, False])
def test_area_under_the_points_is_the_auc(spark, drop):
    points = E.roc_curve(scored(spark, TIED), drop_collinear=drop, buckets=3).collect()
    xy = sorted((r.fpr, r.tpr) for r in points)
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(xy, xy[1:], strict=False))
    assert area == pytest.approx(pairwise_auc(TIED), abs=1e-9)
    assert xy[0] == (0.0, 0.0) and xy[-1] == (1.0, 1.0)


def test_no_predicted_positive_counts_as_zero(spark):
    row = E.threshold_metrics(scored(spark, [(1, 0.5), (0, 0.1)])).first()
    assert (row.precision, row.recall, row.f1_score, row.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_log_loss_clips_exact_zero_and_one(spark):
    row = E.threshold_metrics(scored(spark, [(1, 0.0), (0, 0.0)])).first()
    assert row.log_loss == pytest.approx(-math.log(2.220446049250313e-16) / 2, rel=1e-9)
    assert row.brier_score == 0.5


def test_calibration_bins_take_their_upper_edge(spark):
    pairs = [(1, e) for e in (0.0, 0.1, 0.2, 0.30000000000000004, 0.5, 0.9, 0.95, 1.0)]
    got = {r.bin: r.n for r in E.calibration_curve(scored(spark, pairs)).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 4: 1, 8: 1, 9: 2}


def test_report_rows(spark):
    pairs = [(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1), (0, 0.3)]
    rows = {r["class"]: r for r in E.classification_report(scored(spark, pairs)).collect()}
    assert rows["1"].precision == 0.5 and rows["0"].recall == pytest.approx(2 / 3)
    assert rows["accuracy"].support == rows["accuracy"].precision == pytest.approx(0.6)
    assert rows["macro avg"].recall == pytest.approx((0.5 + 2 / 3) / 2)
    assert rows["weighted avg"].support == 5


# Published metric rows of one role: accuracy, precision, recall, F1, log loss, Brier, AUC.
PUBLISHED = {
    "Top": [(0.889831, 0.906648, 0.869153, 0.887504, 0.284672, 0.080079, 0.957262),
            (0.887458, 0.885367, 0.890169, 0.887762, 0.279759, 0.083429, 0.953196),
            (0.892881, 0.886076, 0.901695, 0.893817, 0.251628, 0.075860, 0.961255),
            (0.895593, 0.891348, 0.901017, 0.896156, 0.251961, 0.074176, 0.962870)],
    "Support": [(0.891864, 0.907616, 0.872542, 0.889734, 0.274042, 0.078170, 0.959542),
                (0.898305, 0.895091, 0.902373, 0.898717, 0.244070, 0.072777, 0.965889),
                (0.908814, 0.908537, 0.909153, 0.908844, 0.222841, 0.067751, 0.970584),
                (0.905424, 0.912983, 0.896271, 0.904550, 0.225792, 0.067741, 0.970051)],
}


def published(spark):
    models = ["logistic", "random_forest", "xgboost", "neural_network"]
    rows = [(r, m, *v) for r, vs in PUBLISHED.items() for m, v in zip(models, vs, strict=True)]
    return spark.createDataFrame(
        rows, "role string, model string, accuracy double, precision double, recall double,"
        " f1_score double, log_loss double, brier_score double, auc_roc double")


def test_best_published_model_by_auc(spark):
    got = {r.role: (r.model, r.best_model) for r in E.best_model(published(spark)).collect()}
    assert got == {"Top": ("neural_network", "Neural Network"), "Support": ("xgboost", "Xgboost")}


def test_best_model_ties_and_default(spark):
    tied = published(spark).withColumn("auc_roc", F.lit(0.9))
    assert {r.model for r in E.best_model(tied).collect()} == {"logistic"}
    roles = spark.createDataFrame([("Top",), ("Mid",)], "role string")
    got = {r.role: r.model for r in E.best_model_or_default(published(spark), roles).collect()}
    assert got == {"Top": "neural_network", "Mid": "xgboost"}


def test_metric_pivot_and_direction(spark):
    rows = E.metric_pivot(E.metrics_long(published(spark))).collect()
    cell = {(r.metric, r.role): r for r in rows}
    assert cell["auc_roc", "Top"].neural_network == 0.962870
    assert cell["log_loss", "Top"].lower_is_better and not cell["accuracy", "Top"].lower_is_better


# ---- splits ------------------------------------------------------------------------------------


def stratified(spark, sizes):
    rows = [(r, y, f"{r}-{y}-{i}", i // 2) for (r, y), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "role string, win int, key string, game_id int")


SIZES = {("Top", 1): 103, ("Top", 0): 57, ("Mid", 1): 2, ("Mid", 0): 1}


def test_split_is_exact_in_every_stratum_and_repeatable(spark):
    df = stratified(spark, SIZES)
    first = SP.stratified_split(df, ["role", "win"], ["key"])
    again = SP.stratified_split(df.repartition(5), ["role", "win"], ["key"])
    counts = {(r.role, r.win): r.n for r in first.where("is_test").groupBy("role", "win").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {("Top", 1): 21, ("Top", 0): 11}
    assert {(r.key, r.is_test) for r in first.collect()} == {(r.key, r.is_test) for r in again.collect()}
    assert first.count() == sum(SIZES.values())


def test_folds_are_even(spark):
    df = SP.split_with_folds(stratified(spark, SIZES), ["role", "win"], ["key"])
    top = df.where("role = 'Top' AND win = 1 AND NOT is_test").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in top) == [27, 27, 28]


def test_groups_stay_together(spark):
    df = stratified(spark, SIZES)
    out = SP.stratified_split(df, ["role", "win"], ["key"], group="game_id").collect()
    sides = {}
    for r in out:
        sides.setdefault(r.game_id, set()).add(r.is_test)
    assert all(len(s) == 1 for s in sides.values())
    assert sum(True in s for s in sides.values()) == round(0.2 * len(sides))


def test_sample_limits_rows_before_the_shuffle(spark):
    df = stratified(spark, SIZES)
    sample = SP.seeded_sample(df, 10, ["key"], ["role"])
    assert {r.role: r["count"] for r in sample.groupBy("role").count().collect()} == {
        "Top": 10, "Mid": 3}
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
