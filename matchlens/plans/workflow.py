"""The whole analysis as phases over stored tables, each of which can be skipped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.operators import evaluate, explain, pressure, training
from matchlens.operators.features import engineer_features, role_dataset, with_teams
from matchlens.operators.reshape import to_long
from matchlens.operators.scoring import positive_probability
from matchlens.operators.series import one_row_per_game, series_flags, with_series_flags
from matchlens.plans.report import final_report
from matchlens.schema import FEATURES, LOWER_IS_BETTER, METRICS, MODELS
from matchlens.sources import model_store
from matchlens.sources.storage import materialize, pinned, write_merged, write_partitioned


@dataclass
class Outcome:
    """What the phases left behind; a skipped phase leaves its entries empty.

    ``frames`` holds the further tables of the evaluate, explain and pressure phases by name; every
    one is stored under its name in the run's folder.
    """

    player_games: DataFrame
    report: DataFrame | None = None
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    shap: DataFrame | None = None
    fits: list[training.Fit] = field(default_factory=list)
    failures: list[tuple[str, str, str]] = field(default_factory=list)
    frames: dict[str, DataFrame] = field(default_factory=dict)


def preprocess(player_games: DataFrame, spread: list[str]) -> DataFrame:
    """Series flags and features on every player row."""
    flags = series_flags(one_row_per_game(player_games))
    return engineer_features(with_series_flags(player_games, flags, spread))


def explain_fits(
    fits: list[training.Fit], rows: DataFrame, key: str, n_permutations: int, background: int
) -> DataFrame:
    """Shapley values of all fits on the sampled rows of their role, one wide frame.

    The sample (at most a hundred rows per role) is stored once and read by every fit.
    """
    design = explain.permutation_design(len(FEATURES), n_permutations)
    columns = ["role", key, "sample_no", *FEATURES]
    sample = pinned(explain.explained_sample(rows, [key], ["role"]).select(*columns), "sample")
    parts = []
    for fit in fits:
        here = sample.where(F.col("role") == fit.role)
        values = explain.shapley_values(
            here,
            here,
            lambda df, m=fit.model: positive_probability(m.transform(df), "score"),
            design,
            [key],
            ["role"],
            FEATURES,
            background,
        )
        parts.append(
            values.join(here.select("role", key, *FEATURES), ["role", key]).withColumn(
                "model", F.lit(fit.family)
            )
        )
    return explain.combine(parts)


def evaluation_frames(scored: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the evaluation views, from scored rows and their metrics."""
    long = to_long(metrics, ["role", "model"], METRICS).withColumn(
        "lower_is_better", F.col("metric").isin(LOWER_IS_BETTER)
    )
    return {
        "roc_curve": evaluate.roc_curve(scored),
        "calibration_curve": evaluate.calibration_curve(scored),
        "confusion_matrix": evaluate.confusion_matrix(scored),
        "classification_report": evaluate.classification_report(scored),
        "metric_comparison": evaluate.metric_pivot(long),
        "metric_range": evaluate.metric_range(long),
        "best_model": evaluate.best_model(metrics),
    }


def explanation_frames(shap: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables behind the importance and dependence views."""
    by = ["role", "model"]
    importance = explain.mean_abs_shap(shap, by)
    long = explain.shap_long(shap, [*by, key])
    return {
        "importance": explain.with_scale(explain.with_share(importance, by)),
        "importance_comparison": explain.importance_comparison(importance),
        "role_comparison": explain.role_comparison(importance),
        "dependence": explain.dependence_frame(long, importance, by),
    }


def pressure_frames(rows: DataFrame) -> dict[str, DataFrame]:
    """Slopes, summaries and tiers of the three pressure contexts, from flagged rows with scores."""
    kept = ["player", "win", "state", "international", "bo5", "final3", "performance_score"]
    narrow = rows.select(*kept, "blue_team", "red_team", "winning_team")
    input_rows = pinned(with_teams(narrow), "pressure")
    contexts = pressure.pressure_rows(input_rows, keep=["opponent_team"])
    plain, adjusted = pressure.fit_both(contexts, "opponent_team")
    slopes = adjusted.players.select("context", "player", "med", "lo", "hi", "pr_pos")
    return {
        "pressure_slopes": adjusted.players,
        "pressure_population": adjusted.population,
        "pressure_ranks": pressure.rank_slopes(slopes, ["context"]),
        "pressure_effects": pressure.effect_comparison(plain, adjusted),
        "pressure_loo": pressure.loo_comparison(plain, adjusted),
        "pressure_tiers": pressure.clutch_tiers(slopes),
        "pressure_bands": pressure.sensitivity_bands(slopes),
    }


def run(
    spark: SparkSession,
    collect,
    out: str,
    key: str = "row_key",
    spread: list[str] | None = None,
    skip: frozenset[str] | set[str] = frozenset(),
    families: list[str] = MODELS,
    settings=training.draw_parameters,
    n_permutations: int = 4,
    background: int = explain.FALLBACK_BACKGROUND_ROWS,
    inputs: list[str] | None = None,
) -> Outcome:
    """Collect, preprocess, train, evaluate, explain, measure pressure and report.

    ``collect`` builds the player-game rows; its result and that of preprocessing are written under
    ``out`` and read back by later runs; with ``inputs``, the files and folders that ``collect`` reads,
    only while these are unchanged. ``skip`` may hold ``train``, ``evaluate``, ``explain`` and
    ``pressure``; evaluation and explanation need training in the same run. Pressure needs rows
    with ``performance_score``, ``state`` and ``international`` and is left out without them.
    """
    spread = spread or [key]
    raw = materialize(spark, f"{out}/player_games", collect, inputs)
    settings_of = None if inputs is None else {"spread": spread}
    rows = materialize(spark, f"{out}/preprocessed", lambda: preprocess(raw, spread), inputs, settings_of)
    outcome = Outcome(rows)

    def keep(frames: dict[str, DataFrame]) -> None:
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{out}/{name}")
            outcome.frames[name] = spark.read.parquet(f"{out}/{name}")

    write_merged(rows.drop("series_id"), f"{out}/merged", "csv")
    if "train" not in skip:
        prepared = training.prepare_training(rows, key, path=f"{out}/training")
        outcome.fits = training.train_roles(
            prepared, families, settings, failures=outcome.failures
        )
        model_store.save_models(outcome.fits, f"{out}/models")
        keep({
            "model_specs": training.model_specs(spark, outcome.fits),
            "failures": training.failure_rows(spark, outcome.failures),
        })
        test = prepared.where("is_test")
        if "evaluate" not in skip:
            scored = training.score_fits(outcome.fits, test, key)
            write_partitioned(scored, f"{out}/predictions", "role", "model")
            outcome.predictions = spark.read.parquet(f"{out}/predictions")
            outcome.metrics = evaluate.all_metrics(outcome.predictions)
            write_partitioned(outcome.metrics, f"{out}/metrics", "role", "model")
            outcome.metrics = spark.read.parquet(f"{out}/metrics")
            keep(evaluation_frames(outcome.predictions, outcome.metrics))
        if "explain" not in skip:
            shap = explain_fits(outcome.fits, test, key, n_permutations, background)
            write_partitioned(shap, f"{out}/shap", "role", "model")
            outcome.shap = spark.read.parquet(f"{out}/shap")
            keep(explanation_frames(outcome.shap, key))
    if "pressure" not in skip and {"performance_score", "state", "international"} <= set(rows.columns):
        keep(pressure_frames(rows))
    outcome.report = final_report(rows, role_dataset(rows), outcome.metrics)
    keep({"report": outcome.report})
    outcome.report = outcome.frames["report"]
    return outcome
