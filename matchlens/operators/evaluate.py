"""Evaluation of scored rows ``(role, model, label, prediction, probability)``.

Everything is an aggregate over those rows; a group (role and model) may hold any share of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.numeric import LOG_LOSS_EPS
from matchlens.functions.text import display_name
from matchlens.operators.ordered import ordered_scan
from matchlens.operators.reshape import to_long, to_wide
from matchlens.schema import LOWER_IS_BETTER, METRICS, MODELS

BY = ["role", "model"]

# --- fixed values: inner edges of ten equal bins, as the doubles of an evenly spaced grid --------
BIN_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5,
             0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
# -------------------------------------------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(pred: DataFrame, by: list[str] = BY) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    return pred.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def threshold_metrics(pred: DataFrame, by: list[str] = BY) -> DataFrame:
    """Accuracy, precision, recall, F1, log loss and Brier score in one pass."""
    y, p = F.col("label"), F.col("probability")
    hard = F.col("prediction")
    clipped = F.least(F.greatest(p, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    sums = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (hard == 1)).alias("tp"),
        F.count_if((y == 0) & (hard == 1)).alias("fp"),
        F.count_if((y == 1) & (hard == 0)).alias("fn"),
        F.count_if(y == hard).alias("hit"),
        (-F.avg(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        *by,
        "n",
        (F.col("hit") / F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        "log_loss",
        "brier_score",
    )


def score_counts(pred: DataFrame, by: list[str] = BY) -> DataFrame:
    """Positives and negatives per distinct score: ties merge before anything is ordered."""
    return pred.groupBy(*by, "probability").agg(
        F.count_if(F.col("label") == 1).alias("np"), F.count_if(F.col("label") == 0).alias("nn")
    )


def roc_auc(pred: DataFrame, by: list[str] = BY, buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half. NULL with one class only."""
    scanned = ordered_scan(
        score_counts(pred, by), ["probability"], by,
        sums={"neg_below": F.col("nn")}, buckets=buckets,
    )
    return scanned.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("np") * (F.col("neg_below") + F.col("nn") / 2)),
            F.sum("np").cast("double") * F.sum("nn"),
        ).alias("auc_roc")
    )


def roc_curve(
    pred: DataFrame, by: list[str] = BY, drop_collinear: bool = True, buckets: int | None = None
) -> DataFrame:
    """ROC points: the origin (NULL threshold), then one point per distinct score.

    ``drop_collinear`` leaves out points whose step equals that of the next lower score.
    """
    scanned = ordered_scan(
        score_counts(pred, by), ["probability"], by,
        sums={"pos_below": F.col("np"), "neg_below": F.col("nn")},
        lags={"lower_np": "np", "lower_nn": "nn"}, totals=True, buckets=buckets,
    )
    pos, neg = F.col("pos_below_total"), F.col("neg_below_total")
    points = scanned.select(
        *by,
        F.col("probability").alias("threshold"),
        F.try_divide(neg - F.col("neg_below"), neg).alias("fpr"),
        F.try_divide(pos - F.col("pos_below"), pos).alias("tpr"),
        F.col("lower_np").isNull().alias("lowest"),
        ((F.col("lower_np") == F.col("np")) & (F.col("lower_nn") == F.col("nn"))).alias("same"),
        ((F.col("pos_below") + F.col("np") == pos) & (F.col("neg_below") + F.col("nn") == neg))
        .alias("highest"),
    )
    if drop_collinear:
        points = points.where(F.col("lowest") | F.col("highest") | ~F.col("same"))
    origin = pred.select(*by).distinct().select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.select(*by, "threshold", "fpr", "tpr").unionByName(origin)


def calibration_curve(pred: DataFrame, by: list[str] = BY) -> DataFrame:
    """Ten equal probability bins (empty ones left out): mean score and share of positives."""
    p = F.col("probability")
    bin_no = reduce(lambda a, b: a + b, [(p > e).cast("int") for e in BIN_EDGES])
    return (
        pred.withColumn("bin", bin_no)
        .groupBy(*by, "bin")
        .agg(
            F.avg("probability").alias("mean_predicted"),
            F.avg("label").alias("fraction_positive"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def confusion_matrix(pred: DataFrame, by: list[str] = BY) -> DataFrame:
    """One row per true label, one column per predicted label."""
    return (
        pred.groupBy(*by, "label")
        .agg(
            F.count_if(F.col("prediction") == 0).alias("pred_0"),
            F.count_if(F.col("prediction") == 1).alias("pred_1"),
        )
    )


def classification_report(pred: DataFrame, by: list[str] = BY) -> DataFrame:
    """Rows ``0, 1, accuracy, macro avg, weighted avg`` with precision, recall, F1 and support.

    One pass over the scored rows; the five rows per group come from its four counts.
    """
    counts = confusion_counts(pred, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    accuracy = (tp + tn) / total

    def f1(a: Column, wrong: Column) -> Column:
        return _ratio(2 * a, 2 * a + wrong)

    p0, r0, f0, s0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), f1(tn, fn + fp), tn + fp
    p1, r1, f1_, s1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), f1(tp, fn + fp), tp + fn

    def row(name, precision, recall, f1_score, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1_score.alias("f1_score"),
            support.cast("double").alias("support"),
        )

    def weighted(a, b):
        return (a * s0 + b * s1) / total

    report = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1_, s1),
        row("accuracy", accuracy, accuracy, accuracy, accuracy),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, total),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1_), total),
    )
    return counts.select(*by, F.inline(report))


def all_metrics(pred: DataFrame, by: list[str] = BY, buckets: int | None = None) -> DataFrame:
    """The seven metrics per group, one wide row each (groups are few: roles times models)."""
    return threshold_metrics(pred, by).join(roc_auc(pred, by, buckets), by, "left")


def metrics_long(wide: DataFrame, by: list[str] = BY) -> DataFrame:
    """Metric rows with display names and the direction of improvement."""
    return to_long(wide, by, METRICS).select(
        *by,
        "metric",
        display_name("model").alias("model_name"),
        display_name("metric").alias("metric_name"),
        F.col("metric").isin(LOWER_IS_BETTER).alias("lower_is_better"),
        "value",
    )


def metric_pivot(long: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Role by model, for every metric in one frame."""
    return to_wide(long, ["metric", "lower_is_better", "role"], "model", models)


def best_model(wide: DataFrame, metric: str = "auc_roc") -> DataFrame:
    """Best model per role by ``metric``; among equals the first in the fixed model order."""
    order = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    usable = wide.where(F.col(metric).isNotNull())
    return (
        usable.groupBy("role")
        .agg(F.max_by(F.struct("*"), F.struct(F.col(metric), -order)).alias("b"))
        .select(
            "role",
            F.col("b.model").alias("model"),
            display_name("b.model").alias("best_model"),
            *[F.col(f"b.{m}").alias(m) for m in METRICS if m in wide.columns],
        )
    )


def best_model_or_default(
    wide: DataFrame, roles: DataFrame, default: str = "xgboost"
) -> DataFrame:
    """``role, model`` for every role of ``roles``; ``default`` where no metrics are known."""
    metric = "auc_roc" if "auc_roc" in wide.columns else "accuracy"
    best = best_model(wide, metric).select("role", "model")
    return roles.select("role").join(best, "role", "left").select(
        "role", F.coalesce("model", F.lit(default)).alias("model")
    )


def metric_range(
    long: DataFrame, pad: float = 0.002, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Display range per metric: the value range widened by ``pad``, clamped to [low, high]."""
    return long.groupBy("metric").agg(
        F.greatest(F.lit(low), F.min("value") - pad).alias("range_low"),
        F.least(F.lit(high), F.max("value") + pad).alias("range_high"),
    )
