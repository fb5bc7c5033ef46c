"""Canonical names, types and fixed vocabularies of the match tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
ROLES = ["Top", "Jungle", "Mid", "ADC", "Support"]
MODELS = ["logistic", "random_forest", "xgboost", "neural_network"]
FEATURES = [
    "kde", "dpm", "multi_kill", "gpm", "vspm", "wcpm",
    "gd_15", "xpd_15", "csd_15", "lvld_15", "dtpd",
]
CONTEXTS = ["playoff", "international", "bo5_final"]
METRICS = ["accuracy", "precision", "recall", "f1_score", "auc_roc", "log_loss", "brier_score"]
LOWER_IS_BETTER = ["log_loss", "brier_score"]

# Source header -> canonical column name.
RENAMES = {
    "Game_ID": "game_id",
    "Blue_Team": "blue_team",
    "Red_Team": "red_team",
    "Winning_Team": "winning_team",
    "Win": "win",
    "Player": "player",
    "Role": "role",
    "Kills": "kills",
    "Deaths": "deaths",
    "Assists": "assists",
    "Double kills": "double_kills",
    "Triple kills": "triple_kills",
    "Quadra kills": "quadra_kills",
    "Penta kills": "penta_kills",
    "Total damage taken": "total_damage_taken",
    "DMG%": "dmg_pct",
    "KP%": "kp_pct",
    "DPM": "dpm",
    "GPM": "gpm",
    "VSPM": "vspm",
    "WCPM": "wcpm",
    "GD@15": "gd_15",
    "XPD@15": "xpd_15",
    "CSD@15": "csd_15",
    "LVLD@15": "lvld_15",
    "State": "state",
    "Tourney": "tourney",
    "final_games": "final3",
    "final3_game": "final3",
}
# ----------------------------------------------------------------------------

PLAYERS_PER_GAME = 10
PLAYERS_PER_TEAM = 5

KILL_COUNTERS = ["double_kills", "triple_kills", "quadra_kills", "penta_kills"]
PERCENT_COLUMNS = ["dmg_pct", "kp_pct"]
INT_STATS = ["kills", "deaths", "assists", *KILL_COUNTERS]
DOUBLE_STATS = [
    "total_damage_taken", "dpm", "gpm", "vspm", "wcpm",
    "gd_15", "xpd_15", "csd_15", "lvld_15",
]

#: Stored player-game rows: explicit, so no inference pass runs over the files.
PLAYER_GAMES = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("player", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("blue_team", T.StringType()),
        T.StructField("red_team", T.StringType()),
        T.StructField("winning_team", T.StringType()),
        T.StructField("win", T.IntegerType()),
    ]
    + [T.StructField(c, T.IntegerType()) for c in INT_STATS]
    + [T.StructField(c, T.DoubleType()) for c in DOUBLE_STATS]
    + [T.StructField(c, T.StringType()) for c in PERCENT_COLUMNS]
)

#: Stat names as they stand in the first column of a result page, by canonical name.
PAGE_STATS = {
    canonical: source
    for source, canonical in RENAMES.items()
    if canonical not in ("game_id", "blue_team", "red_team", "winning_team", "win")
}

#: Input of the pressure analysis as it is stored: booleans and numbers are text in the file.
PRESSURE_INPUT = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("player", T.StringType()),
        T.StructField("bo5", T.BooleanType()),
        T.StructField("final3", T.BooleanType()),
        T.StructField("tourney", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("international", T.BooleanType()),
        T.StructField("performance_score", T.DoubleType()),
        T.StructField("own_team", T.StringType()),
        T.StructField("opponent_team", T.StringType()),
    ]
)
