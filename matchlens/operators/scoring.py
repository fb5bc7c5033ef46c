"""Scalers, the linear scorer as plain columns, and scoring with stored models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions.match import role_display, stat_or_zero, threshold_label
from matchlens.functions.numeric import sigmoid
from matchlens.schema import FEATURES, ROLES
from matchlens.sources.storage import scratch_path, write_partitioned


def scaler_stats(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Mean and population standard deviation per role, one wide row per role (at most five)."""
    return (
        df.where(F.col("role").isin(ROLES))
        .groupBy("role")
        .agg(
            *[F.avg(f).alias(f"{f}_mean") for f in features],
            *[F.stddev_pop(f).alias(f"{f}_std") for f in features],
        )
    )


def standardised(feature: str) -> Column:
    """``(x - mean) / std`` next to the scaler columns; a constant feature divides by one."""
    std = F.col(f"{feature}_std")
    return (F.col(feature) - F.col(f"{feature}_mean")) / F.when(std > 0, std).otherwise(1.0)


def standardise(
    df: DataFrame, stats: DataFrame, features: list[str] = FEATURES, prefix: str = "z_"
) -> DataFrame:
    """Add the standardised features. ``stats`` has one row per role, five at most."""
    joined = df.join(F.broadcast(stats), "role")
    drop = [f"{f}_{s}" for f in features for s in ("mean", "std")]
    return joined.withColumns({f"{prefix}{f}": standardised(f) for f in features}).drop(*drop)


def coefficient_table(
    spark: SparkSession, rows: list[tuple], features: list[str] = FEATURES
) -> DataFrame:
    """``(role, model, intercept, coefficient of each feature ...)`` as a small wide table."""
    schema = "role string, model string, intercept double, " + ", ".join(
        f"b_{f} double" for f in features
    )
    return spark.createDataFrame(rows, schema)


def linear_margin(features: list[str] = FEATURES, prefix: str = "z_") -> Column:
    """Log-odds of a linear model whose coefficients stand next to the features."""
    terms = [F.col(f"b_{f}") * F.col(f"{prefix}{f}") for f in features]
    return reduce(lambda a, b: a + b, terms, F.col("intercept"))


def linear_score(
    df: DataFrame, stats: DataFrame, coefficients: DataFrame, features: list[str] = FEATURES
) -> DataFrame:
    """Probability of a win from fixed coefficients: one map-side pass, no model object."""
    scored = standardise(df, stats, features).join(F.broadcast(coefficients), "role")
    return scored.withColumn("win_probability", sigmoid(linear_margin(features))).drop(
        "intercept", *[f"b_{f}" for f in features], *[f"z_{f}" for f in features]
    )


def as_prediction(df: DataFrame, keep: list[str]) -> DataFrame:
    """The scoring output: prediction, probability and the rating that equals it."""
    return df.select(
        *keep,
        F.col("model").alias("model_used"),
        threshold_label("win_probability").alias("win_prediction"),
        "win_probability",
        F.col("win_probability").alias("skill_rating"),
    )


def positive_probability(scored: DataFrame, name: str = "win_probability") -> DataFrame:
    """Probability of class 1 as a plain double instead of the vector columns."""
    return scored.withColumn(name, vector_to_array("probability")[1])


def prepare_players(
    players: DataFrame, role_column: str = "role", features: list[str] = FEATURES
) -> DataFrame:
    """Scoring input: role in its display spelling, absent or missing stats as zero."""
    filled = {f: stat_or_zero(f) if f in players.columns else F.lit(0.0) for f in features}
    return players.withColumns(filled).withColumn("role", role_display(role_column))


def batch_predict(
    players: DataFrame,
    models: dict[str, tuple[str, Transformer]],
    key: str,
    role_column: str = "role",
) -> DataFrame:
    """Score every player with the chosen model of the player's role.

    ``models`` maps role to (model name, fitted model); each is loaded once by the caller. The
    inputs are written once, a folder per role, and each role reads its own folder. Players whose
    role is unknown or has no model stay, without a prediction.
    """
    spark = players.sparkSession
    path = scratch_path(spark, "players")
    prepared = prepare_players(players, role_column).select(
        F.col(key).alias("player_id"), "role", *FEATURES
    )
    write_partitioned(prepared, path, "role")
    ready = spark.read.schema(prepared.schema).parquet(path)
    parts = [
        as_prediction(
            positive_probability(
                model.transform(ready.where(F.col("role") == role))
            ).withColumn("model", F.lit(name)),
            ["player_id", "role"],
        )
        for role, (name, model) in models.items()
    ]
    unscored = ready.where(~F.coalesce(F.col("role").isin(list(models)), F.lit(False)))
    empty = {"model": F.lit(None).cast("string"), "win_probability": F.lit(None).cast("double")}
    parts.append(as_prediction(unscored.withColumns(empty), ["player_id", "role"]))
    return reduce(DataFrame.unionByName, parts)


def predict_one(
    spark: SparkSession, stats: dict[str, float], role: str, model_name: str, model: Transformer
) -> dict:
    """One player's stats through the batch path; absent stats count as zero."""
    row = [float(stats.get(f, 0) or 0) for f in FEATURES]
    schema = "player_id string, role string, " + ", ".join(f"{f} double" for f in FEATURES)
    df = spark.createDataFrame([("0", role, *row)], schema)
    display = next((r for r in ROLES if r.lower() == role.strip().lower()), None)
    if display is None:
        raise ValueError(f"no model available for role {role}")
    ready = prepare_players(df).select("player_id", "role", *FEATURES)
    scored = positive_probability(model.transform(ready)).withColumn("model", F.lit(model_name))
    return as_prediction(scored, ["player_id", "role"]).first().asDict()


def quick_predict(
    spark: SparkSession, stats: dict[str, float], role: str, model_name: str, model: Transformer
) -> float:
    """The skill rating alone."""
    return predict_one(spark, stats, role, model_name, model)["skill_rating"]
