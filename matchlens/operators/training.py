"""Per-role win models: parameter search, cross-validation and final fits on ``pyspark.ml``.

Each (role, family) is an independent set of Spark jobs; they are submitted from a few driver
threads. The prepared rows are written once, one folder per role, so every fit reads only its
role's eleven features, label and fold.
"""

from __future__ import annotations

import itertools
import logging
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions.match import threshold_label
from matchlens.operators.explain import combine
from matchlens.operators.features import enough_samples, role_dataset
from matchlens.operators.scoring import positive_probability, scaler_stats
from matchlens.operators.split import split_with_folds
from matchlens.schema import FEATURES, MODELS, ROLES
from matchlens.sources.storage import pinned, scratch_path, write_partitioned

log = logging.getLogger(__name__)

# --- fixed values: value lists of the parameter search ----------------------
PARAMETER_GRIDS = {
    "logistic": {
        "penalty": ["l1", "l2", "elasticnet", "none"],
        "C": [
            0.0001, 0.000774263682681127, 0.005994842503189409, 0.046415888336127774, 0.3593813663804626,
            2.782559402207126, 21.54434690031882, 166.81005372000558, 1291.5496650148827, 10000.0,
        ],
        "max_iter": [100, 1000],
    },
    "random_forest": {
        "n_estimators": [50, 100, 200],
        "max_depth": [3, 5, 7, None],
        "min_samples_leaf": [1, 2, 4],
        "bootstrap": [True, False],
    },
    "xgboost": {
        "n_estimators": [50, 100, 200],
        "max_depth": [3, 5, 7],
        "learning_rate": [0.01, 0.1, 0.2],
        "subsample": [0.8, 1.0],
        "colsample_bytree": [0.8, 1.0],
        "gamma": [0.0, 0.1, 0.2],
    },
    "neural_network": {
        "epochs": [50, 100],
        "n_hidden": [1, 2],
        "n_neurons": list(range(10, 100, 10)),
    },
}
SEARCH_BUDGET = {"logistic": 20, "random_forest": 20, "xgboost": 20, "neural_network": 10}
UNLIMITED_DEPTH = 30  # the deepest trees the library grows, for "no limit"
ROWS_AT_ONCE = 2_000_000  # rows that the fits running at one time may hold, as each keeps a copy of its own
#: Settings of the search that the library's estimators do not have.
NO_COUNTERPART = {
    "logistic": ["solver"],
    "random_forest": ["min_samples_split"],
    "xgboost": ["reg_alpha", "reg_lambda"],
    "neural_network": ["learning_rate", "optimizer", "dropout", "activation"],
}
# ----------------------------------------------------------------------------

#: Families whose inputs are standardised.
SCALED = ("logistic", "neural_network")


def parameter_grid(family: str) -> list[dict]:
    """Every combination of the family's value lists."""
    lists = PARAMETER_GRIDS[family]
    return [dict(zip(lists, v, strict=True)) for v in itertools.product(*lists.values())]


def draw_parameters(family: str, n_iter: int | None = None, seed: int = 42) -> list[dict]:
    """A seeded draw without replacement of ``n_iter`` combinations."""
    grid = parameter_grid(family)
    n = min(n_iter or SEARCH_BUDGET[family], len(grid))
    return random.Random(f"{family}-{seed}").sample(grid, n)


def dense_parameters(layers: list[int]) -> int:
    """Weights and biases of a dense net: ``in * out + out`` summed over its layers."""
    return sum(i * o + o for i, o in itertools.pairwise(layers))


def classifier(family: str, p: dict, n_rows: int, n_features: int, seed: int = 42) -> Estimator:
    """The library classifier of a family with the settings of one draw.

    Settings without a counterpart (`NO_COUNTERPART`) are not in the grids. Colsample maps to the feature subset tried
    per node, gamma to the minimum information gain, and the net is sigmoid.
    """
    cols = {"featuresCol": "features", "labelCol": "win"}
    if family == "logistic":
        penalty = p.get("penalty", "l2")
        return LogisticRegression(
            **cols,
            elasticNetParam={"l1": 1.0, "elasticnet": 0.5}.get(penalty, 0.0),
            regParam=0.0 if penalty == "none" else 1.0 / (p.get("C", 1.0) * n_rows),
            maxIter=p.get("max_iter", 100),
            standardization=False,
        )
    if family == "random_forest":
        return RandomForestClassifier(
            **cols,
            numTrees=p.get("n_estimators", 100),
            maxDepth=p.get("max_depth") or UNLIMITED_DEPTH,
            minInstancesPerNode=p.get("min_samples_leaf", 1),
            bootstrap=p.get("bootstrap", True),
            featureSubsetStrategy="sqrt",
            seed=seed,
        )
    if family == "xgboost":
        return GBTClassifier(
            **cols,
            maxIter=p.get("n_estimators", 100),
            maxDepth=p.get("max_depth", 3),
            stepSize=p.get("learning_rate", 0.1),
            subsamplingRate=p.get("subsample", 1.0),
            featureSubsetStrategy=str(p.get("colsample_bytree", 1.0)),
            minInfoGain=p.get("gamma", 0.0),
            seed=seed,
        )
    if family == "neural_network":
        hidden = [p.get("n_neurons", 30)] * p.get("n_hidden", 1)
        return MultilayerPerceptronClassifier(
            **cols,
            layers=[n_features, *hidden, 2],
            maxIter=p.get("epochs", 100),
            seed=seed,
        )
    raise ValueError(f"unknown model family {family}")


def input_stages(train: DataFrame, family: str, features: list[str] = FEATURES) -> list:
    """Stages that turn feature columns into the model's vector, scaler included.

    The scaler's numbers are taken from the training rows and stored as literals in the stage,
    so a saved model always scores with the scaling it was trained on.
    """
    if family not in SCALED:
        return [VectorAssembler(inputCols=features, outputCol="features")]
    stats = scaler_stats(train, features).first()
    scaled = ", ".join(
        f"(`{f}` - ({stats[f + '_mean']!r}D)) / {stats[f + '_std'] or 1.0!r}D AS `__z_{f}`"
        for f in features
    )
    return [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__z_{f}" for f in features], outputCol="features"),
    ]


@dataclass
class Fit:
    """A chosen model: its settings, its mean cross-validated AUC, and the fitted stages."""

    role: str
    family: str
    params: dict
    cv_auc: float | None
    model: PipelineModel
    n_train: int
    searched: list[tuple[dict, float]] = field(default_factory=list)


def fold_scores(vectors: DataFrame, estimators: list[Estimator], folds: int = 3, parallelism: int = 2) -> list[float]:
    """Mean ROC-AUC of every estimator over the folds, each fitted on the rows of the other folds.

    ``vectors`` (``features, win, fold``) should be persisted: every fit and every evaluation filters it, no
    fold is stored on its own.
    """
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="win", numBins=0)

    def one(fold: int, estimator: Estimator) -> float:
        model = estimator.fit(vectors.where(F.col("fold") != fold))
        return evaluator.evaluate(model.transform(vectors.where(F.col("fold") == fold)))

    jobs = list(itertools.product(range(folds), estimators))
    with ThreadPoolExecutor(parallelism) as pool:
        run = inheritable_thread_target(vectors.sparkSession)(one)
        scores = list(pool.map(lambda job: run(*job), jobs))
    return [sum(scores[i :: len(estimators)]) / folds for i in range(len(estimators))]


def at_once(most: int, rows: int) -> int:
    """How many of ``most`` fits over ``rows`` rows each run at one time, one at least."""
    return max(1, min(most, ROWS_AT_ONCE // max(1, rows)))


def fit_family(
    train: DataFrame,
    role: str,
    family: str,
    settings: list[dict],
    folds: int = 3,
    parallelism: int = 2,
    features: list[str] = FEATURES,
    seed: int = 42,
) -> Fit:
    """Search ``settings`` by cross-validated ROC-AUC and fit the best one on all rows.

    ``train`` carries a ``fold`` column. With a single setting there is nothing to search. The vectors are held in
    memory, or on the executors' disks where that is full, once for all fits and evaluations. Large
    fits, which fill the cluster alone, run one after the other.
    """
    inputs = Pipeline(stages=input_stages(train, family, features)).fit(train)
    vectors = inputs.transform(train).select("features", "win", "fold").persist()
    try:
        in_fold = {r["fold"]: r["count"] for r in vectors.groupBy("fold").count().collect()}  # a row per fold
        n_rows = sum(in_fold.values())
        scores: list[tuple[dict, float]] = []
        chosen, best_auc = 0, None
        if len(settings) > 1:
            if set(in_fold) != set(range(folds)) or folds < 2:
                raise ValueError(f"folds 0 to {folds - 1} must all have rows, found {in_fold}")
            # a penalty is scaled by the rows a fit sees: inside the search all folds but one
            n_search = n_rows * (folds - 1) // folds
            estimators = [classifier(family, p, n_search, len(features), seed) for p in settings]
            scores = list(zip(settings, fold_scores(vectors, estimators, folds, at_once(parallelism, n_rows)), strict=True))
            chosen, (_, best_auc) = max(enumerate(scores), key=lambda s: s[1][1])
        model = classifier(family, settings[chosen], n_rows, len(features), seed).fit(vectors)
    finally:
        vectors.unpersist()
    stages = [*inputs.stages, model]
    return Fit(role, family, settings[chosen], best_auc, PipelineModel(stages), n_rows, scores)


def prepare_training(
    df: DataFrame,
    key: str = "row_key",
    min_samples: int = 100,
    test_fraction: float = 0.2,
    folds: int = 3,
    seed: int = 42,
    group: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Role data set with ``is_test`` and ``fold``, written once by role and read back.

    Roles with fewer than ``min_samples`` complete rows are left out. The complete rows are stored
    before they are split, because finding the cut points reads their keys several times.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "training")
    rows = enough_samples(pinned(role_dataset(df, keep=[key]), "roles"), min_samples)
    rows = split_with_folds(rows, ["role", "win"], [key], test_fraction, folds, seed, group)
    write_partitioned(rows, path, "role")
    return spark.read.parquet(path)


def train_roles(
    prepared: DataFrame,
    families: list[str] = MODELS,
    settings: Callable[[str], list[dict]] = draw_parameters,
    roles: list[str] = ROLES,
    folds: int = 3,
    threads: int = 4,
    seed: int = 42,
    failures: list[tuple[str, str, str]] | None = None,
) -> list[Fit]:
    """Fit every family for every role.

    A fit that fails is logged, goes as (role, family, error) to ``failures``, and the others go
    on; when nothing could be fitted, that is an error.
    """
    failed = [] if failures is None else failures

    def one(role: str, family: str) -> Fit | None:
        train = prepared.where((F.col("role") == role) & ~F.col("is_test"))
        try:
            return fit_family(train, role, family, settings(family), folds, seed=seed)
        except Exception as error:
            log.exception("training failed for %s %s", role, family)
            failed.append((role, family, f"{type(error).__name__}: {error}"))
            return None

    present = {r.role: r["count"] for r in prepared.groupBy("role").count().collect()}
    jobs = [(r, f) for r in roles if r in present for f in families]
    session: SparkSession = prepared.sparkSession
    with ThreadPoolExecutor(at_once(threads, max(present.values(), default=0))) as pool:
        run = inheritable_thread_target(session)(one)
        fits = list(pool.map(lambda job: run(*job), jobs))
    if jobs and len(failed) >= len(jobs):
        raise RuntimeError(f"no model could be fitted: {failed[0]}")
    return [f for f in fits if f is not None]


def failure_rows(spark: SparkSession, failures: list[tuple[str, str, str]]) -> DataFrame:
    """``role, family, error`` of the fits that failed."""
    return spark.createDataFrame(failures, "role string, family string, error string")


def score_fits(fits: list[Fit], rows: DataFrame, key: str = "row_key") -> DataFrame:
    """Scored rows ``role, model, key, label, prediction, probability`` of all fits.

    Every model gets the inputs it was trained on: its scaler is one of its stages.
    """
    parts = []
    for fit in fits:
        scored = positive_probability(
            fit.model.transform(rows.where(F.col("role") == fit.role)), "p"
        )
        parts.append(
            scored.select(
                "role",
                F.lit(fit.family).alias("model"),
                key,
                F.col("win").alias("label"),
                threshold_label("p").alias("prediction"),
                F.col("p").alias("probability"),
            )
        )
    return combine(parts)


def model_specs(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """Settings of each fitted model, one row per setting (a few rows of driver metadata)."""
    rows = []
    for fit in fits:
        values = {k: v for k, v in fit.params.items()}
        values |= {"n_train": fit.n_train, "cv_auc": fit.cv_auc}
        final = fit.model.stages[-1]
        if fit.family == "neural_network":
            layers = list(final.getLayers())
            total = dense_parameters(layers)
            values |= {
                "layers": "-".join(map(str, layers)),
                "total_params": total,
                "trainable_params": total,
                "non_trainable_params": 0,
                "solver": final.getSolver(),
                "loss": "cross entropy",
            }
        elif fit.family == "logistic":
            values |= {"reg_param": final.getRegParam(), "intercept": final.intercept}
        else:
            values |= {"trees": len(final.trees), "depth": final.getMaxDepth()}
        values |= {name: "no counterpart" for name in NO_COUNTERPART[fit.family]}
        rows += [(fit.family, fit.role, k, str(v)) for k, v in values.items()]
    return spark.createDataFrame(rows, "family string, role string, setting string, value string")
