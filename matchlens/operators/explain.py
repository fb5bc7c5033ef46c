"""Shapley values of scored rows, and the frames behind importance and dependence views."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlens.operators.reshape import to_long, to_wide
from matchlens.operators.split import seeded_sample
from matchlens.schema import FEATURES, ROLES
from matchlens.sources.storage import sized

# --- fixed values: sizes of the explained sample and its background ---------
SAMPLE_ROWS = 100
BACKGROUND_ROWS = 50
FALLBACK_BACKGROUND_ROWS = 20
TOP_FEATURES = 10
TOP_DEPENDENCE = 5
LINEAR_MODELS = ["logistic"]
# ----------------------------------------------------------------------------
#: Coalitions, with their complements, in each design of the kernel-weighted regression.
KERNEL_PAIRS = 24


# ---- closed form for linear models -----------------------------------------------------------


def linear_shap(
    df: DataFrame,
    coefficients: DataFrame,
    by: list[str],
    keep: list[str],
    features: list[str] = FEATURES,
    prefix: str = "z_",
) -> DataFrame:
    """Exact Shapley values of a linear model on the margin scale, columns ``shap_<feature>``.

    ``coef * (x - mean of x over the background)``; the background is the explained rows of the
    same role. ``df`` holds the model's inputs ``<prefix><feature>``. The means are one row per
    role and the coefficients one per role and model, so the rows are read twice and never move.
    """
    means = (
        df.where(F.col("role").isin(ROLES))
        .groupBy("role")
        .agg(*[F.avg(f"{prefix}{f}").alias(f"m_{f}") for f in features])
    )
    joined = df.join(F.broadcast(means), "role").join(F.broadcast(coefficients), "role")
    return joined.select(
        *by,
        *keep,
        *features,
        *[
            (F.col(f"b_{f}") * (F.col(f"{prefix}{f}") - F.col(f"m_{f}"))).alias(f"shap_{f}")
            for f in features
        ],
    )


def linear_importance(
    df: DataFrame,
    coefficients: DataFrame,
    features: list[str] = FEATURES,
    prefix: str = "z_",
) -> DataFrame:
    """Mean absolute Shapley value of linear models: ``role, model, feature, importance``.

    It is ``|coef| * mean |x - mean of x|``, so the rows are averaged once per role and only those
    few rows meet the coefficients.
    """
    rows = df.where(F.col("role").isin(ROLES))
    means = rows.groupBy("role").agg(*[F.avg(f"{prefix}{f}").alias(f"m_{f}") for f in features])
    spread = rows.join(F.broadcast(means), "role").groupBy("role").agg(
        *[F.avg(F.abs(F.col(f"{prefix}{f}") - F.col(f"m_{f}"))).alias(f"a_{f}") for f in features]
    )
    wide = coefficients.join(spread, "role").select(
        "role", "model", *[(F.abs(f"b_{f}") * F.col(f"a_{f}")).alias(f) for f in features]
    )
    return to_long(wide, ["role", "model"], features, "feature", "importance")


def shap_long(wide: DataFrame, ids: list[str], features: list[str] = FEATURES) -> DataFrame:
    """One row per explained row and feature: value and Shapley value."""
    pair = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("feature_value"),
                F.col(f"shap_{f}").alias("shap"),
            )
            for f in features
        ]
    )
    return wide.select(*ids, F.inline(pair))


# ---- any scorer ------------------------------------------------------------------------------


def exact_design(n: int) -> list[tuple[int, list[float]]]:
    """Every coalition (bit mask) with its Shapley weight for each feature."""
    weight = [math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) for s in range(n)]
    design = []
    for mask in range(2**n):
        size = mask.bit_count()
        design.append(
            (mask, [weight[size - 1] if mask >> j & 1 else -weight[size] for j in range(n)])
        )
    return design


def permutation_design(n: int, n_permutations: int, seed: int = 42) -> list[tuple[int, list[float]]]:
    """Coalitions met along seeded permutations and their reverses, weights averaged over them.

    Each permutation adds the features one by one; a feature gets the score after its step minus
    the score before it. Coalitions met several times are scored once.
    """
    rng = random.Random(seed)
    weights: dict[int, list[float]] = {}
    share = 1.0 / (2 * n_permutations)
    for _ in range(n_permutations):
        order = rng.sample(range(n), n)
        for walk in (order, order[::-1]):
            mask = 0
            for j in walk:
                weights.setdefault(mask, [0.0] * n)[j] -= share
                mask |= 1 << j
                weights.setdefault(mask, [0.0] * n)[j] += share
    return sorted(weights.items())


def kernel_designs(n: int, n_pairs: int, batches: int = 6, seed: int = 42) -> list[list[tuple[int, list[float]]]]:
    """Independent designs of the kernel-weighted regression, each of ``n_pairs`` coalitions and their complements.

    Coalition sizes are drawn by the Shapley kernel, members at random. The values are the least-squares
    fit of the coalitions' scores under the constraint that they add up to the whole gain. All rows
    share the coalitions, so the solved normal equations are one weight per coalition and feature.
    For two features or more; where the pairs do not tell the features apart, more are drawn.
    """
    rng = random.Random(seed)
    full, sizes = 2**n - 1, range(1, n)
    designs = []
    for _ in range(batches):
        times: dict[int, int] = {}
        drawn, members = 0, np.zeros((0, n))
        while drawn < n_pairs or np.linalg.matrix_rank(members) < n:
            (size,) = rng.choices(sizes, [1.0 / (s * (n - s)) for s in sizes])
            mask = sum(1 << j for j in rng.sample(range(n), size))
            for m in (mask, full ^ mask):
                times[m] = times.get(m, 0) + 1
            drawn += 1
            if drawn >= n_pairs:
                members = np.array([[m >> j & 1 for j in range(n)] for m in times], dtype=float)
        share = np.array(list(times.values())) / (2.0 * drawn)
        normal = members.T @ (members * share[:, None])
        inverse = np.linalg.inv(normal)
        ones = inverse.sum(axis=1)
        project = inverse - np.outer(ones, ones) / ones.sum()
        inner = (members * share[:, None]) @ project
        whole = ones / ones.sum()
        weights = {m: w.tolist() for m, w in zip(times, inner, strict=True)}
        weights[0], weights[full] = (-inner.sum(axis=0) - whole).tolist(), whole.tolist()
        designs.append(sorted(weights.items()))
    return designs


def kernel_shapley(
    rows: DataFrame,
    background: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    designs: list[list[tuple[int, list[float]]]],
    key: list[str],
    by: list[str],
    features: list[str],
    background_rows: int = BACKGROUND_ROWS,
) -> DataFrame:
    """Kernel-weighted Shapley values of any scorer: ``shap_<feature>``, the mean over the designs, and
    ``se_<feature>``, its standard error from their spread (null for a single design).

    One job scores every coalition of all designs once. The values add up to the score less the mean
    background score; for a linear scorer they are exact.
    """
    nothing = [0.0] * len(features)
    held = [dict(d) for d in designs]
    joint = [(m, [w for d in held for w in d.get(m, nothing)]) for m in sorted(set().union(*held))]
    parts = [[f"__{i}_{f}" for f in features] for i in range(len(designs))]
    wide = shapley_values(rows, background, score, joint, key, by, features, background_rows, outputs=[c for p in parts for c in p])
    count = len(designs)

    def mean(j: int):
        return reduce(lambda a, b: a + b, [F.col(p[j]) for p in parts]) / count

    def error(j: int):
        squares = reduce(lambda a, b: a + b, [(F.col(p[j]) - mean(j)) * (F.col(p[j]) - mean(j)) for p in parts])
        return F.sqrt(squares / (count * (count - 1))) if count > 1 else F.lit(None).cast("double")

    return wide.select(
        *by, *key, *[mean(j).alias(f"shap_{f}") for j, f in enumerate(features)], *[error(j).alias(f"se_{f}") for j, f in enumerate(features)]
    )


def shapley_values(
    rows: DataFrame,
    background: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    design: list[tuple[int, list[float]]],
    key: list[str],
    by: list[str],
    features: list[str],
    background_rows: int = BACKGROUND_ROWS,
    max_cells: int | None = None,
    outputs: list[str] | None = None,
) -> DataFrame:
    """Shapley values of any scorer, columns ``shap_<feature>`` per ``by`` and ``key``.

    Each row meets the background rows of its group (at most ``background_rows``, held as one
    array per group) and every coalition of the design; features in the coalition come from the
    row, the others from the background. ``score`` adds the column ``score``. Rows are dealt over
    all tasks before they are multiplied; ``rows`` is small and is read twice, so pass a stored
    table. The weighted sums are aggregated map-side, so what is shuffled is one partial row per
    explained row and task. ``max_cells`` refuses more scored cells per row, if given. ``outputs``
    names the weighted sums where the design has other weights than one per feature.
    """
    cells = background_rows * len(design)
    if max_cells is not None and cells > max_cells:
        raise ValueError(f"{cells} scored cells per row; use fewer permutations or features")
    bg = (
        background.where(F.col("sample_no") <= background_rows)
        .groupBy(*by)
        .agg(F.collect_list(F.struct(*features)).alias("__bg"))
    )
    coalitions = F.from_json(
        F.lit(json.dumps([{"mask": m, "w": w} for m, w in design])),
        "array<struct<mask: int, w: array<double>>>",
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = (
        rows.select(*by, *key, *[F.col(f).alias(f"__x_{f}") for f in features])
        .join(sized(bg, limit=1000), by)
        .repartition(tasks, *by, *key)
        .withColumn("__n", F.size("__bg"))
        .withColumn("__b", F.explode("__bg"))
        .withColumn("__c", F.explode(coalitions))
        .select(
            *by,
            *key,
            "__n",
            F.col("__c.w").alias("__w"),
            *[
                F.when(F.col("__c.mask").bitwiseAND(1 << j) != 0, F.col(f"__x_{f}"))
                .otherwise(F.col(f"__b.{f}"))
                .alias(f)
                for j, f in enumerate(features)
            ],
        )
    )
    return (
        score(mixed)
        .groupBy(*by, *key)
        .agg(
            *[
                F.sum(F.col("__w")[j] * F.col("score") / F.col("__n")).alias(name)
                for j, name in enumerate(outputs or [f"shap_{f}" for f in features])
            ]
        )
    )


def explained_sample(
    df: DataFrame, key: list[str], by: list[str], n: int = SAMPLE_ROWS, seed: int = 42
) -> DataFrame:
    """The rows to explain; the first of them are also the background."""
    return seeded_sample(df, n, key, by, seed)


# ---- importance, comparison, dependence ------------------------------------------------------


def mean_abs_shap(
    wide: DataFrame, by: list[str], features: list[str] = FEATURES
) -> DataFrame:
    """Mean absolute Shapley value per group and feature; only the group row is made long."""
    agg = wide.groupBy(*by).agg(*[F.avg(F.abs(f"shap_{f}")).alias(f) for f in features])
    return to_long(agg, by, features, "feature", "importance")


def with_scale(importance: DataFrame) -> DataFrame:
    """Marks the scale of an importance: linear models are explained on the margin, others on the
    probability."""
    linear = F.col("model").isin(LINEAR_MODELS)
    return importance.withColumn("scale", F.when(linear, "margin").otherwise("probability"))


def with_share(importance: DataFrame, by: list[str]) -> DataFrame:
    """Importance as a share within its group: comparable across margin and probability scales."""
    total = F.sum("importance").over(W.partitionBy(*by))
    return importance.withColumn("share", F.try_divide("importance", total))


def importance_comparison(importance: DataFrame, roles: list[str] = ROLES) -> DataFrame:
    """Per model and feature one column per role; a missing combination counts as zero."""
    wide = to_wide(importance, ["model", "feature"], "role", roles, "importance")
    return wide.na.fill(0.0, subset=roles)


def common_feature_order(importance: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The ``k`` features with the largest mean of per-role importances, per model.

    At most one row per model and feature comes in, so the window is a handful of rows.
    """
    overall = importance.groupBy("model", "feature").agg(
        F.avg("importance").alias("mean_importance")
    )
    w = W.partitionBy("model").orderBy(F.desc("mean_importance"), "feature")
    return overall.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def top_features(importance: DataFrame, by: list[str], k: int = TOP_DEPENDENCE) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return importance.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def role_comparison(
    importance: DataFrame, k: int = TOP_FEATURES
) -> DataFrame:
    """Importance of the common top features in every role, in one order for all roles."""
    order = common_feature_order(importance, k).select("model", "feature", "position")
    return importance.join(order, ["model", "feature"])


def dependence_frame(
    long: DataFrame, importance: DataFrame, by: list[str], k: int = TOP_DEPENDENCE
) -> DataFrame:
    """Value and Shapley value of every row for the ``k`` leading features of its group.

    The list of leading features has ``k`` rows per role and model, both from fixed lists.
    """
    leading = top_features(importance, by, k).select(*by, "feature", "position")
    return long.join(F.broadcast(leading), [*by, "feature"])


def combine(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
