"""Feature engineering and role datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions import match as M
from matchlens.schema import FEATURES, PERCENT_COLUMNS, ROLES


def engineer_features(player_games: DataFrame) -> DataFrame:
    """Add ``kde, multi_kill, dtpd`` and turn percent strings into fractions (map-only)."""
    derived = {"kde": M.kde(), "multi_kill": M.multi_kill(), "dtpd": M.dtpd()}
    derived |= {c: M.percent_fraction(c) for c in PERCENT_COLUMNS if c in player_games.columns}
    return player_games.withColumns(derived)


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing is NULL only: in Spark NaN compares greater than any number."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    chosen = [c for c in (columns or doubles) if c in doubles]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen})


def feature_report(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """One row per feature: is the column there, and how many rows have and lack a value.

    One aggregation over all rows; the result is the features' names and counts only.
    """
    present = [f for f in features if f in df.columns]
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(f).alias(f"n_{f}") for f in present]
    )
    entry = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(f in present).alias("available"),
                (F.col(f"n_{f}") if f in present else F.lit(0).cast("long")).alias("n_present"),
                F.col("__rows").alias("n_rows"),
            )
            for f in features
        ]
    )
    return counted.select(F.inline(entry)).withColumn(
        "n_missing", F.col("n_rows") - F.col("n_present")
    )


def role_dataset(
    df: DataFrame, keep: list[str] | None = None, features: list[str] = FEATURES
) -> DataFrame:
    """Rows of the five roles with every available feature present, all roles in one frame."""
    available = [f for f in features if f in df.columns]
    cols = [*(keep or []), *available, "win", "role", "game_id"]
    return (
        df.select(*dict.fromkeys(cols))
        .where(F.col("role").isin(ROLES))
        .na.drop(subset=[*available, "win"])
    )


def role_summary(df: DataFrame) -> DataFrame:
    """Samples and win rate per role."""
    return df.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("win").alias("win_rate")
    )


def enough_samples(df: DataFrame, min_samples: int = 100) -> DataFrame:
    """Only rows of roles with at least ``min_samples`` rows.

    The kept roles are at most the five of the fixed list, so the filter is a broadcast.
    """
    kept = df.groupBy("role").count().where(F.col("count") >= min_samples).select("role")
    return df.join(F.broadcast(kept.where(F.col("role").isin(ROLES))), "role", "left_semi")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Player rows, distinct games and series flags, each at both grains, in one pass per grain.

    The game grain is reached by a per-game partial aggregate instead of distinct counts.
    """
    per_game = df.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("bo5").alias("bo5_rows"),
        F.count_if("final3").alias("final3_rows"),
    )
    return per_game.agg(
        F.sum("rows").alias("player_rows"),
        F.count(F.lit(1)).alias("games"),
        F.sum("bo5_rows").alias("bo5_player_rows"),
        F.count_if(F.col("bo5_rows") > 0).alias("bo5_games"),
        F.sum("final3_rows").alias("final3_player_rows"),
        F.count_if(F.col("final3_rows") > 0).alias("final3_games"),
    )


def with_teams(df: DataFrame) -> DataFrame:
    """Own and opponent team of each player row."""
    return df.withColumns({"own_team": M.own_team(), "opponent_team": M.opponent_team()})
