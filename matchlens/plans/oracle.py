"""The same results as plain SQL for DuckDB, written the direct way (global windows, row joins)."""

from __future__ import annotations

from matchlens.functions.numeric import (
    DIGAMMA_TERMS, ERF_A, ERF_P, GAMMA_SHIFT, QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D, QUANTILE_TAIL, TRIGAMMA_TERMS,
)
from matchlens.operators.explain import KERNEL_PAIRS, kernel_designs
from matchlens.schema import FEATURES, METRICS, MODELS, ROLES
from matchlens.sources import match_views as mv

ORACLES: dict[str, str] = {}

PG = mv.plain_sql(mv.PLAYER_GAMES)
PRED = mv.plain_sql(mv.PREDICTIONS)
HEADERS = mv.plain_sql(mv.HEADER_TEXT)


def r(x: str, digits: int = 6) -> str:
    """Rounded, and without a negative zero."""
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def text(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def case_of(column: str, pairs: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {column} {whens} END"


def add(name: str, ctes: list[tuple[str, str]], select: str) -> None:
    with_ = ",\n".join(f"{n} AS ({q})" for n, q in ctes)
    ORACLES[name] = f"WITH {with_}\n{select}" if ctes else select


MODEL_NAMES = {
    "logistic": "Logistic", "random_forest": "Random Forest", "xgboost": "Xgboost",
    "neural_network": "Neural Network",
}
METRIC_NAMES = {
    "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1_score": "F1 Score",
    "auc_roc": "Auc Roc", "log_loss": "Log Loss", "brier_score": "Brier Score",
}

# ---- series ----------------------------------------------------------------------------------

GAMES = [
    ("pg", PG),
    ("g", "SELECT game_id, min(blue_team) AS blue_team, min(red_team) AS red_team,"
          " min(winning_team) AS winning_team FROM pg GROUP BY game_id"),
]
SERIES = [
    *GAMES,
    ("b", "SELECT *, least(blue_team, red_team) AS ta, greatest(blue_team, red_team) AS tb FROM g"),
    ("k", "SELECT *, CASE WHEN lag(ta) OVER (ORDER BY game_id) = ta"
          " AND lag(tb) OVER (ORDER BY game_id) = tb THEN 0 ELSE 1 END AS brk,"
          " row_number() OVER (ORDER BY game_id) AS rn FROM b"),
    ("i", "SELECT *, sum(brk) OVER (ORDER BY game_id ROWS UNBOUNDED PRECEDING) AS isl FROM k"),
    ("s", "SELECT *, row_number() OVER (PARTITION BY isl ORDER BY game_id) AS pos,"
          " count(*) OVER (PARTITION BY isl) AS len, min(rn) OVER (PARTITION BY isl) AS sid FROM i"),
    ("w", "SELECT *, max(CASE WHEN pos = 1 THEN winning_team END) OVER (PARTITION BY isl) AS w1,"
          " max(CASE WHEN pos = 2 THEN winning_team END) OVER (PARTITION BY isl) AS w2 FROM s"),
    ("flags", "SELECT game_id, sid AS series_id, pos, len AS series_len,"
              " len >= 4 OR (len = 3 AND w1 = w2) AS bo5, len >= 4 AND pos > len - 3 AS final3"
              " FROM w"),
]
add("series_flags", SERIES, "SELECT game_id, CAST(series_id AS BIGINT) AS series_id, pos,"
    " series_len, bo5, final3 FROM flags")
add("role_series_summary", SERIES,
    f"SELECT role, count(*) AS n_samples, CAST(sum(win) AS BIGINT) AS n_wins,"
    f" CAST(sum(CASE WHEN bo5 THEN 1 ELSE 0 END) AS BIGINT) AS bo5_rows,"
    f" CAST(sum(CASE WHEN final3 THEN 1 ELSE 0 END) AS BIGINT) AS final3_rows,"
    f" {r('avg(win)')} AS win_rate FROM pg JOIN flags USING (game_id) GROUP BY role")
add("game_order_scan", GAMES,
    "SELECT game_id, row_number() OVER (ORDER BY game_id) - 1 AS games_before,"
    " CAST(coalesce(sum(CASE WHEN winning_team = blue_team THEN 1 ELSE 0 END) OVER"
    " (ORDER BY game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
    " AS blue_wins_before, lag(winning_team) OVER (ORDER BY game_id) AS previous_winner FROM g")
add("player_series_join", SERIES,
    "SELECT row_key, game_id, role, win, bo5, final3 FROM pg LEFT JOIN flags USING (game_id)")
add("ordered_games", GAMES, "SELECT * FROM g ORDER BY game_id")
SUMMARY = ("SELECT count(*) AS player_rows, count(DISTINCT game_id) AS games,"
           " CAST(count_if(bo5) AS BIGINT) AS bo5_player_rows,"
           " count(DISTINCT CASE WHEN bo5 THEN game_id END) AS bo5_games,"
           " CAST(count_if(final3) AS BIGINT) AS final3_player_rows,"
           " count(DISTINCT CASE WHEN final3 THEN game_id END) AS final3_games"
           " FROM pg JOIN flags USING (game_id)")
add("dataset_summary", SERIES, SUMMARY)

# ---- features --------------------------------------------------------------------------------

FEATURE_ROWS = [
    ("pg", PG),
    ("fe", """SELECT * EXCLUDE (dmg_pct, kp_pct),
       (kills + assists) / (deaths + 1) AS kde,
       CASE WHEN double_kills > 0 OR triple_kills > 0 OR quadra_kills > 0 OR penta_kills > 0
            THEN 1 ELSE 0 END AS multi_kill,
       total_damage_taken / (deaths + 1) AS dtpd,
       TRY_CAST(trim(trim(dmg_pct, ' '), '%') AS DOUBLE) / 100 AS dmg_pct,
       TRY_CAST(trim(trim(kp_pct, ' '), '%') AS DOUBLE) / 100 AS kp_pct FROM pg"""),
]
FEATURE_SELECT = (f"SELECT row_key, {r('kde')} AS kde, multi_kill, {r('dtpd')} AS dtpd,"
                  f" {r('dmg_pct')} AS dmg_pct, {r('kp_pct')} AS kp_pct FROM fe")
add("engineer_features", FEATURE_ROWS, FEATURE_SELECT)
add("stream_ingest", FEATURE_ROWS, FEATURE_SELECT)

_raw = [f for f in FEATURES if f not in ("kde", "multi_kill", "dtpd")]
add("feature_availability", [("pg", PG)], " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {'true' if f in _raw else 'false'} AS available,"
    f" {f'count({f})' if f in _raw else 'CAST(0 AS BIGINT)'} AS n_present, count(*) AS n_rows,"
    f" count(*) - {f'count({f})' if f in _raw else '0'} AS n_missing FROM pg" for f in FEATURES))

_present = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
ROLE_ROWS = [
    *FEATURE_ROWS,
    ("rr", f"SELECT row_key, {', '.join(FEATURES)}, win, role, game_id, player, state, blue_team,"
           f" red_team, winning_team FROM fe"
           f" WHERE role IN {text(ROLES)} AND win IS NOT NULL AND {_present}"),
]
ROLE_SUMMARY = (f"SELECT role, count(*) AS n_samples, {r('avg(win)')} AS win_rate"
                " FROM rr GROUP BY role")
add("role_dataset_summary", ROLE_ROWS, ROLE_SUMMARY + " HAVING count(*) >= 100")
add("batches_by_role", ROLE_ROWS, ROLE_SUMMARY)
add("role_order_report", ROLE_ROWS,
    "SELECT d.role, d.ord, n_wins FROM (VALUES "
    + ", ".join(f"({i}, '{x}')" for i, x in enumerate(ROLES))
    + ") d(ord, role) LEFT JOIN (SELECT role, count(*) AS n_wins FROM rr WHERE win = 1"
      " GROUP BY role) USING (role)")

OTHER = "CASE WHEN winning_team = blue_team THEN red_team ELSE blue_team END"
TEAMS = (f"CASE WHEN win = 1 THEN winning_team ELSE {OTHER} END AS own_team,"
         f" CASE WHEN win = 1 THEN {OTHER} ELSE winning_team END AS opponent_team")
add("own_opponent", [("pg", PG)], f"SELECT row_key, {TEAMS} FROM pg")
add("role_keys", [("pg", PG)],
    "SELECT row_key, role, lower(role) AS role_key, abs(gd_15) AS abs_gd_15,"
    f" {r('CAST(CAST(dpm AS FLOAT) AS DOUBLE)', 3)} AS dpm_single FROM pg")
add("win_by_slot", [("pg", PG)],
    "SELECT row_key, CASE WHEN (slot - 1 < 5) = (winning_team = blue_team) THEN 1 ELSE 0 END"
    " AS win FROM pg")

# ---- batches, files, pages -------------------------------------------------------------------

BATCHES = [
    ("pg", PG),
    ("u", "SELECT row_key, game_id, role, state, kills, gd_15 FROM pg WHERE state = 'Regular'"
          " UNION ALL SELECT row_key, game_id, role, state, kills, NULL FROM pg"
          " WHERE state = 'Playoffs'"
          " UNION ALL SELECT row_key, game_id, role, state, kills, NULL FROM pg"
          " WHERE state = 'Playoffs'"),
]
add("merge_batches", BATCHES,
    "SELECT state, role, count(*) AS n_rows, CAST(sum(kills) AS BIGINT) AS kills,"
    " count(gd_15) AS n_gd_15 FROM u GROUP BY state, role")
add("drop_batch_copies", BATCHES,
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY game_id,"
    " role, state, kills, gd_15 NULLS FIRST) AS rn FROM u) WHERE rn = 1")
add("csv_roundtrip", FEATURE_ROWS,
    f"SELECT game_id, player, role, win, kills, {r('dpm')} AS dpm, {r('gd_15')} AS gd_15,"
    f" {r('kp_pct')} AS kp_pct FROM fe")
_bad = "(slot % 3 = 2 AND deaths = 3)"
add("batch_files_by_name", [("pg", PG)],
    f"SELECT game_id, player, role, win, CASE WHEN NOT {_bad} THEN kills END AS kills,"
    f" {r('dpm')} AS dpm, CASE WHEN slot % 3 <> 2 THEN {r('gd_15')} END AS gd_15,"
    " CASE slot % 3 WHEN 0 THEN 'all_matches.csv' WHEN 1 THEN 'all_matches_batch_2.csv'"
    f" ELSE 'all_matches_batch_12.csv' END AS batch_file, NOT {_bad} AS good FROM pg")
add("fuller_copies", [("pg", PG)],
    "SELECT row_key, kills, gd_15, xpd_15, CASE WHEN gd_15 IS NULL AND xpd_15 IS NOT NULL"
    " THEN 'all_matches.csv' ELSE 'all_matches_batch_4.csv' END AS batch_file FROM pg QUALIFY"
    " row_number() OVER (PARTITION BY row_key ORDER BY CAST(gd_15 IS NOT NULL AS INT)"
    " + CAST(xpd_15 IS NOT NULL AS INT) DESC, gd_15 IS NULL AND xpd_15 IS NOT NULL DESC, kills) = 1")
add("stream_csv", FEATURE_ROWS, FEATURE_SELECT)
add("valid_games", [("pg", PG)],
    "SELECT row_key, game_id, player FROM pg WHERE game_id IN"
    " (SELECT game_id FROM pg GROUP BY game_id HAVING count(*) = 5)")
add("rejected_games", [("pg", PG)],
    "SELECT game_id, count(*) AS n_rows FROM pg GROUP BY game_id HAVING count(*) <> 5")
add("stream_games", [("pg", PG)],
    "SELECT row_key, game_id, player, CASE WHEN n = 5 THEN 'whole' ELSE 'too many players' END AS status"
    " FROM (SELECT *, count(*) OVER (PARTITION BY game_id) AS n FROM pg) WHERE n >= 5")
add("dirty_rows", [("pg", PG)],
    "SELECT row_key, gd_15, CASE WHEN gd_15 IS NOT NULL THEN CAST(kills AS DOUBLE) END AS kills,"
    " gd_15 IS NOT NULL AS good FROM pg")
add("missing_values", [("pg", PG)], "SELECT row_key, gd_15, xpd_15 FROM pg")
PARSED = [
    ("h", HEADERS),
    ("p", "SELECT game_id, trim(split_part(replace(blue_text, chr(10), ' '), ' - ', 1)) AS blue_team,"
          " trim(split_part(replace(red_text, chr(10), ' '), ' - ', 1)) AS red_team,"
          " upper(blue_text) LIKE '%WIN%' AS bw, upper(red_text) LIKE '%WIN%' AS rw FROM h"),
    ("q", "SELECT game_id, blue_team, red_team, CASE WHEN bw THEN blue_team WHEN rw THEN red_team"
          " END AS winning_team FROM p"),
    ("parsed", "SELECT *, CASE WHEN winning_team IS NULL THEN 'no winner'"
               " WHEN blue_team = 'Unknown' OR red_team = 'Unknown' THEN 'unknown team' END"
               " AS reject FROM q"),
]
add("header_parse", PARSED, "SELECT * FROM parsed")
add("page_rejects", [
    *PARSED,
    ("x", f"SELECT o_orderkey AS k, {mv.PAGE_PLAYERS.replace('k %', 'o_orderkey %')}"
          " AS players FROM orders"),
    ("w", "SELECT k AS game_id, CASE WHEN players <> 10 THEN 'wrong number of players' ELSE reject"
          " END AS reject FROM x JOIN parsed ON game_id = k"),
], "SELECT game_id, reject FROM w WHERE reject IS NOT NULL")
_pv = {k: v.replace("k ", "k ") for k, v in mv.PAGE_VALUES.items()}
add("page_to_rows", [
    *PARSED,
    ("x", f"SELECT o_orderkey AS k, o_custkey, {mv.PAGE_PLAYERS.replace('k %', 'o_orderkey %')}"
          " AS players FROM orders"),
    ("y", "SELECT x.*, CAST(range AS BIGINT) AS slot FROM x, range(10) WHERE players = 10"),
],
    f"SELECT k AS game_id, CAST(slot AS INTEGER) AS slot, {_pv['Player']} AS player,"
    f" {_pv['Role']} AS role, CAST({_pv['Kills']} AS INTEGER) AS kills,"
    f" CAST({_pv['Deaths']} AS INTEGER) AS deaths, CAST({_pv['Assists']} AS INTEGER) AS assists,"
    f" CAST({_pv['Double kills']} AS INTEGER) AS double_kills,"
    f" CAST({_pv['Total damage taken']} AS DOUBLE) AS total_damage_taken,"
    f" {r('((k + slot) % 90 + 0.5) / 100')} AS kp_pct, CAST({_pv['DPM']} AS DOUBLE) AS dpm,"
    f" TRY_CAST({_pv['GD@15']} AS DOUBLE) AS gd_15, CAST(NULL AS DOUBLE) AS vspm,"
    " blue_team, red_team, winning_team,"
    " CASE WHEN (slot < 5) = (winning_team = blue_team) THEN 1 ELSE 0 END AS win"
    " FROM y JOIN parsed ON game_id = k WHERE reject IS NULL")

# ---- splits, samples, scaling, scoring -------------------------------------------------------


def hashed(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


STRATUM = f"OVER (PARTITION BY role, win ORDER BY {hashed('row_key', 42)})"
add("stratified_split", ROLE_ROWS,
    f"SELECT row_key, role, row_number() {STRATUM} <= round(0.2 * count(*)"
    " OVER (PARTITION BY role, win)) AS is_test FROM rr")
add("stratified_folds", ROLE_ROWS,
    f"SELECT row_key, role, CASE WHEN rn <= round(n * (1.0 / 3)) THEN 0"
    " WHEN rn <= round(n * (2.0 / 3)) THEN 1 ELSE 2 END AS fold FROM"
    f" (SELECT *, row_number() {STRATUM} AS rn, count(*) OVER (PARTITION BY role, win) AS n"
    " FROM rr)")
add("group_split", [
    *ROLE_ROWS,
    ("u", "SELECT DISTINCT game_id FROM rr"),
    ("t", f"SELECT game_id, row_number() OVER (ORDER BY {hashed('game_id', 42)})"
          " <= round(0.2 * count(*) OVER ()) AS is_test FROM u"),
], "SELECT row_key, game_id, is_test FROM rr JOIN t USING (game_id)")


def sampled(source: str, n: int) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY"
            f" {hashed('row_key', 42)}, row_key) AS sample_no FROM {source}) WHERE sample_no <= {n}")


add("seeded_sample", [*ROLE_ROWS, ("sm", sampled("rr", 100))],
    "SELECT row_key, role, sample_no FROM sm")
STATS = [
    *ROLE_ROWS,
    ("st", "SELECT role, " + ", ".join(
        f"avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std" for f in FEATURES)
        + " FROM rr GROUP BY role"),
]
add("scaler_stats", STATS, "SELECT role, " + ", ".join(
    f"{r(f'{f}_mean')} AS {f}_mean, {r(f'{f}_std')} AS {f}_std" for f in FEATURES) + " FROM st")
SCALED = [
    *STATS,
    ("zz", "SELECT rr.*, " + ", ".join(
        f"({f} - {f}_mean) / CASE WHEN {f}_std > 0 THEN {f}_std ELSE 1.0 END AS z_{f}"
        for f in FEATURES) + " FROM rr JOIN st USING (role)"),
]
add("standardise", SCALED,
    "SELECT row_key, " + ", ".join(f"{r(f'z_{f}')} AS z_{f}" for f in FEATURES) + " FROM zz")


def coefficients(models) -> tuple[str, str]:
    rows = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in row) + ")"
        for row in mv.linear_models(ROLES, models)
    )
    names = ", ".join(["role", "model", "intercept", *[f"b_{f}" for f in FEATURES]])
    return ("co", f"SELECT * FROM (VALUES {rows}) v({names})")


MARGIN = "intercept + " + " + ".join(f"b_{f} * z_{f}" for f in FEATURES)
SCORED = [
    *SCALED,
    coefficients(["logistic"]),
    ("sc", f"SELECT zz.*, model, 1 / (1 + exp(-({MARGIN}))) AS p FROM zz JOIN co USING (role)"),
]
add("linear_score", SCORED,
    f"SELECT row_key AS player_id, role, model AS model_used,"
    f" CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS win_prediction,"
    f" {r('p')} AS win_probability, {r('p')} AS skill_rating FROM sc")
add("performance_scores", SCORED,
    f"SELECT row_key, game_id, player, {TEAMS}, state, {r('p')} AS performance_score FROM sc")

# ---- evaluation ------------------------------------------------------------------------------

EPS = "2.220446049250313e-16"
CORE = [
    ("pr", PRED),
    ("cp", f"SELECT *, least(greatest(probability, {EPS}), 1 - {EPS}) AS pc FROM pr"),
    ("cn", "SELECT role, model, count(*) AS n, sum(label * prediction) AS tp,"
           " sum((1 - label) * prediction) AS fp, sum(label * (1 - prediction)) AS fn,"
           " sum((1 - label) * (1 - prediction)) AS tn,"
           " -avg(label * ln(pc) + (1 - label) * ln(1 - pc)) AS log_loss,"
           " avg((probability - label) * (probability - label)) AS brier_score"
           " FROM cp GROUP BY role, model"),
    ("core", "SELECT role, model, n, (tp + tn) / n AS accuracy,"
             " coalesce(tp / nullif(tp + fp, 0), 0) AS precision,"
             " coalesce(tp / nullif(tp + fn, 0), 0) AS recall,"
             " coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score,"
             " log_loss, brier_score FROM cn"),
    # Mid-rank (Mann-Whitney) form of the area.
    ("rk", "SELECT role, model, label, rank() OVER w + (count(*) OVER (PARTITION BY role, model,"
           " probability) - 1) / 2 AS mid FROM pr"
           " WINDOW w AS (PARTITION BY role, model ORDER BY probability)"),
    ("auc", "SELECT role, model, (sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2)"
            " / nullif(sum(label) * sum(1 - label), 0) AS auc_roc FROM rk GROUP BY role, model"),
    ("met", "SELECT core.*, auc_roc FROM core LEFT JOIN auc USING (role, model)"),
]
_core_cols = ["accuracy", "precision", "recall", "f1_score", "log_loss", "brier_score"]
add("metrics_core", CORE, "SELECT role, model, n, "
    + ", ".join(f"{r(c)} AS {c}" for c in _core_cols) + " FROM core")
add("roc_auc", CORE, f"SELECT role, model, {r('auc_roc')} AS auc_roc FROM auc")
ROC = [
    ("pr", PRED),
    ("dc", "SELECT role, model, probability AS threshold, sum(label) AS np, sum(1 - label) AS nn"
           " FROM pr GROUP BY ALL"),
    ("cu", "SELECT *, sum(np) OVER w AS tps, sum(nn) OVER w AS fps,"
           " sum(np) OVER (PARTITION BY role, model) AS tot_p,"
           " sum(nn) OVER (PARTITION BY role, model) AS tot_n,"
           " lead(np) OVER w AS next_np, lead(nn) OVER w AS next_nn,"
           " lag(threshold) OVER w AS higher, lead(threshold) OVER w AS lower FROM dc"
           " WINDOW w AS (PARTITION BY role, model ORDER BY threshold DESC)"),
]
_points = (f"SELECT role, model, {r('threshold')} AS threshold, {r('fps / tot_n')} AS fpr,"
           f" {r('tps / tot_p')} AS tpr FROM cu")
_origin = " UNION ALL SELECT DISTINCT role, model, NULL, 0.0, 0.0 FROM pr"
add("roc_curve_all_points", ROC, _points + _origin)
add("roc_curve", ROC, _points + " WHERE higher IS NULL OR lower IS NULL OR np <> next_np"
    " OR nn <> next_nn" + _origin)
EDGES = ["0.1", "0.2", "0.30000000000000004", "0.4", "0.5", "0.6000000000000001",
         "0.7000000000000001", "0.8", "0.9"]
_bin = " + ".join(f"CASE WHEN probability > {e}::DOUBLE THEN 1 ELSE 0 END" for e in EDGES)
add("calibration_curve", [("pr", PRED)],
    f"SELECT role, model, {_bin} AS bin, {r('avg(probability)')} AS mean_predicted,"
    f" {r('avg(label)')} AS fraction_positive, count(*) AS n FROM pr GROUP BY role, model, bin")
add("confusion_matrix", [("pr", PRED)],
    "SELECT role, model, label, CAST(count_if(prediction = 0) AS BIGINT) AS pred_0,"
    " CAST(count_if(prediction = 1) AS BIGINT) AS pred_1 FROM pr GROUP BY role, model, label")


def report_ctes(source: str) -> list[tuple[str, str]]:
    def per_class(c: int) -> str:
        return (f"SELECT role, model, '{c}' AS class, sum(CASE WHEN label = {c} AND prediction = {c}"
                f" THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN prediction = {c} THEN 1 ELSE 0 END) AS"
                f" said, sum(CASE WHEN label = {c} THEN 1 ELSE 0 END) AS support FROM {source}"
                " GROUP BY role, model")

    return [
        ("pc", per_class(0) + " UNION ALL " + per_class(1)),
        ("pm", "SELECT role, model, class, coalesce(hit / nullif(said, 0), 0) AS p,"
               " coalesce(hit / nullif(support, 0), 0) AS q,"
               " coalesce(2 * hit / nullif(said + support, 0), 0) AS f, support FROM pc"),
        ("ac", f"SELECT role, model, avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS a FROM"
               f" {source} GROUP BY role, model"),
        ("al", "SELECT role, model, class, p, q, f, support FROM pm"
               " UNION ALL SELECT role, model, 'accuracy', a, a, a, a FROM ac"
               " UNION ALL SELECT role, model, 'macro avg', avg(p), avg(q), avg(f), sum(support)"
               " FROM pm GROUP BY role, model"
               " UNION ALL SELECT role, model, 'weighted avg', sum(p * support) / sum(support),"
               " sum(q * support) / sum(support), sum(f * support) / sum(support), sum(support)"
               " FROM pm GROUP BY role, model"),
    ]


add("classification_report", [("pr", PRED), *report_ctes("pr")],
    f"SELECT role, model, class, {r('p')} AS precision, {r('q')} AS recall, {r('f')} AS f1_score,"
    f" {r('CAST(support AS DOUBLE)')} AS support FROM al")
LONG = [*CORE, ("lg", " UNION ALL ".join(
    f"SELECT role, model, '{m}' AS metric, {m} AS value FROM met" for m in METRICS))]
LOWER = "metric IN ('log_loss', 'brier_score')"
add("metrics_long", LONG,
    f"SELECT role, model, metric, {case_of('model', MODEL_NAMES)} AS model_name,"
    f" {case_of('metric', METRIC_NAMES)} AS metric_name, {LOWER} AS lower_is_better,"
    f" {r('value')} AS value FROM lg")
add("metric_pivot", LONG,
    f"SELECT metric, {LOWER} AS lower_is_better, role, " + ", ".join(
        f"{r(f'max(CASE WHEN model = {m!r} THEN value END)')} AS {m}" for m in MODELS)
    + " FROM lg GROUP BY metric, role")
_order = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS)) + " END"
BEST = [*CORE, ("best", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY"
                        f" auc_roc DESC, {_order}) AS rn FROM met WHERE auc_roc IS NOT NULL)"
                        " WHERE rn = 1")]
add("best_model", BEST, f"SELECT role, model, {case_of('model', MODEL_NAMES)} AS best_model, "
    + ", ".join(f"{r(m)} AS {m}" for m in METRICS) + " FROM best")
add("metric_range", LONG,
    f"SELECT metric, {r('greatest(0.0, min(value) - 0.002)')} AS range_low,"
    f" {r('least(1.0, max(value) + 0.002)')} AS range_high FROM lg GROUP BY metric")
add("published_metrics", CORE,
    f'SELECT role, model, {r("accuracy")} AS accuracy, {r("precision")} AS precision,'
    f' {r("recall")} AS recall, {r("f1_score")} AS "f1-score",'
    f' {r("auc_roc")} AS "auc-roc", {r("log_loss")} AS "log loss",'
    f' {r("brier_score")} AS "brier score" FROM met')
add("model_inventory", [
    ("pr", PRED),
    ("li", "SELECT lower(role) AS role, model, sum(CAST(round(probability * 1000000) AS BIGINT))"
           " AS bytes FROM pr WHERE NOT (role = 'Support' AND model = 'neural_network')"
           " GROUP BY ALL"),
    ("gr", f"SELECT unnest([{', '.join(repr(x.lower()) for x in ROLES)}]) AS role"),
    ("gm", f"SELECT unnest([{', '.join(repr(x) for x in MODELS)}]) AS model_type"),
], f"SELECT gr.role, model_type, gr.role || '/' || model_type AS file_path,"
   f" {r('coalesce(bytes, 0) / 1048576', 2)} AS file_size_mb, bytes IS NOT NULL AS available"
   " FROM gr CROSS JOIN gm LEFT JOIN li ON li.role = gr.role AND model = model_type")

# ---- explanation -----------------------------------------------------------------------------


def shap_ctes(models, source="zz") -> list[tuple[str, str]]:
    return [
        coefficients(models),
        ("bg", "SELECT role, " + ", ".join(f"avg(z_{f}) AS m_{f}" for f in FEATURES)
               + f" FROM {source} GROUP BY role"),
        ("sh", f"SELECT {source}.*, model, " + ", ".join(
            f"b_{f} * (z_{f} - m_{f}) AS shap_{f}" for f in FEATURES)
            + f" FROM {source} JOIN bg USING (role) JOIN co USING (role)"),
    ]


def shap_rows(extra: str = "row_key, ") -> str:
    return " UNION ALL ".join(
        f"SELECT role, model, {extra}'{f}' AS feature, CAST({f} AS DOUBLE) AS feature_value,"
        f" shap_{f} AS shap FROM sh" for f in FEATURES)


add("linear_shap", [*SCALED, *shap_ctes(["logistic"])],
    "SELECT row_key, role, " + ", ".join(f"{r(f'shap_{f}')} AS shap_{f}" for f in FEATURES)
    + " FROM sh")
add("shap_frame", [*SCALED, ("sm", sampled("zz", 100)), *shap_ctes(["logistic"], "sm"),
                   ("lo", shap_rows())],
    f"SELECT role, model, row_key, feature, {r('feature_value')} AS feature_value,"
    f" {r('shap')} AS shap FROM lo")

# the designs' weights are constants; the sums over coalitions are written out
_designs = kernel_designs(len(FEATURES), KERNEL_PAIRS)
_all_mixed = " + ".join(
    f"({mv.BASE_COEFFICIENTS[f]!r}::DOUBLE) * CASE WHEN (mask >> {j}) & 1 = 1 THEN x.z_{f} ELSE b.z_{f} END"
    for j, f in enumerate(FEATURES))
add("kernel_shapley", [
    *SCALED,
    ("sm", sampled("zz", 100)),
    ("de", "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {m}, [{', '.join(f'{w!r}::DOUBLE' for w in ws)}])" for i, design in enumerate(_designs) for m, ws in design)
        + ") v(batch, mask, w)"),
    ("ma", "SELECT DISTINCT mask FROM de"),
    ("va", f"SELECT x.role, x.row_key, mask, avg(1 / (1 + exp(-({_all_mixed})))) AS value"
           " FROM sm x JOIN sm b ON x.role = b.role AND b.sample_no <= 50 CROSS JOIN ma GROUP BY ALL"),
    ("ba", "SELECT role, row_key, batch, " + ", ".join(f"sum(w[{j + 1}] * value) AS {f}" for j, f in enumerate(FEATURES))
           + " FROM va JOIN de USING (mask) GROUP BY ALL"),
], "SELECT role, row_key, " + ", ".join(f"{r(f'avg({f})')} AS shap_{f}" for f in FEATURES) + ", "
   + ", ".join(f"{r(f'stddev_samp({f}) / sqrt(count(*))')} AS se_{f}" for f in FEATURES) + " FROM ba GROUP BY ALL")

SMALL = ["kde", "gpm", "gd_15", "dtpd"]
# Shapley's definition: weight of a coalition without the feature times the score gained by it.
_mixed = " + ".join(
    f"{mv.BASE_COEFFICIENTS[f]!r} * CASE WHEN (mask >> {j}) & 1 = 1 THEN x.z_{f} ELSE b.z_{f} END"
    for j, f in enumerate(SMALL))
_gain = ", ".join(
    r(f"sum(CASE WHEN (c.mask >> {j}) & 1 = 0 THEN w.weight * (d.value - c.value) END)")
    + f" AS shap_{f}" for j, f in enumerate(SMALL))
add("exact_shapley", [
    *SCALED,
    ("sm", sampled("zz", 100)),
    ("ma", "SELECT range AS mask FROM range(16)"),
    ("va", f"SELECT x.role, x.row_key, mask, avg(1 / (1 + exp(-({_mixed})))) AS value"
           " FROM sm x JOIN sm b ON x.role = b.role AND b.sample_no <= 50 CROSS JOIN ma"
           " GROUP BY ALL"),
    ("we", "SELECT * FROM (VALUES (0, 0.25), (1, 1.0 / 12), (2, 1.0 / 12), (3, 0.25)) v(size, weight)"),
    ("ga", " UNION ALL ".join(
        f"SELECT c.role, c.row_key, {j} AS j, sum(weight * (d.value - c.value)) AS phi FROM va c"
        f" JOIN va d ON c.role = d.role AND c.row_key = d.row_key AND d.mask = c.mask + {2**j}"
        f" JOIN we ON size = bit_count(c.mask) WHERE (c.mask >> {j}) & 1 = 0 GROUP BY ALL"
        for j in range(4))),
], "SELECT role, row_key, " + ", ".join(
    f"{r(f'max(CASE WHEN j = {j} THEN phi END)')} AS shap_{f}" for j, f in enumerate(SMALL))
   + " FROM ga GROUP BY role, row_key")
#: The fixed forest of `leaf_shapley`, as one expression over the mixed inputs.
_forest = (
    "(CASE WHEN {0} <= 0.1 THEN CASE WHEN {1} <= -0.4 THEN 0.2 WHEN {0} <= -0.9 THEN 0.7 ELSE 0.4 END WHEN {2} <= 0.3 THEN 0.5 ELSE 0.9 END"
    " + CASE WHEN {3} <= 0.0 THEN CASE WHEN {2} > -0.2 THEN 0.6 WHEN {3} <= -1.0 THEN 0.1 ELSE 0.3 END"
    " WHEN {1} > 0.5 THEN 0.8 WHEN {0} <= 0.8 THEN 0.35 ELSE 0.15 END"
    " + CASE WHEN {2} <= 0.0 THEN 0.25 ELSE 0.65 END)::DOUBLE / 3"
)
_inputs = [f"(CASE WHEN (mask >> {j}) & 1 = 1 THEN x.z_{f} ELSE b.z_{f} END)" for j, f in enumerate(SMALL)]
add("leaf_shapley", [
    *SCALED,
    ("sm", sampled("zz", 100)),
    ("ma", "SELECT range AS mask FROM range(16)"),
    ("va", f"SELECT x.role, x.row_key, mask, avg({_forest.format(*_inputs)}) AS value"
           " FROM sm x JOIN sm b ON x.role = b.role AND b.sample_no <= 50 CROSS JOIN ma GROUP BY ALL"),
    ("we", "SELECT * FROM (VALUES (0, 0.25), (1, 1.0 / 12), (2, 1.0 / 12), (3, 0.25)) v(size, weight)"),
    ("ga", " UNION ALL ".join(
        f"SELECT c.role, c.row_key, {j} AS j, sum(weight * (d.value - c.value)) AS phi FROM va c"
        f" JOIN va d ON c.role = d.role AND c.row_key = d.row_key AND d.mask = c.mask + {2**j}"
        f" JOIN we ON size = bit_count(c.mask) WHERE (c.mask >> {j}) & 1 = 0 GROUP BY ALL"
        for j in range(4))),
    ("sh", "SELECT role, row_key, " + ", ".join(f"max(CASE WHEN j = {j} THEN phi END) AS shap_{f}" for j, f in enumerate(SMALL))
           + " FROM ga GROUP BY role, row_key"),
], "SELECT role, row_key, 'forest' AS model, " + ", ".join(f"{r(f'shap_{f}')} AS shap_{f}" for f in SMALL)
   + f", {r('lo.value')} AS base, {r('hi.value')} AS score FROM sh JOIN va lo USING (role, row_key) JOIN va hi USING (role, row_key)"
     " WHERE lo.mask = 0 AND hi.mask = 15")
IMPORTANCE = [*SCALED, *shap_ctes(MODELS), ("lo", shap_rows("")),
              ("im", "SELECT role, model, feature, avg(abs(shap)) AS importance FROM lo"
                     " GROUP BY ALL")]
add("shap_importance", IMPORTANCE,
    f"SELECT role, model, feature, {r('importance')} AS importance,"
    f" {r('importance / sum(importance) OVER (PARTITION BY role, model)')} AS share,"
    " CASE WHEN model = 'logistic' THEN 'margin' ELSE 'probability' END AS scale FROM im")
add("importance_comparison", IMPORTANCE, "SELECT model, feature, " + ", ".join(
    f"{r(f'coalesce(max(CASE WHEN role = {x!r} THEN importance END), 0)')} AS \"{x}\""
    for x in ROLES) + " FROM im GROUP BY model, feature")
add("role_comparison", [
    *IMPORTANCE,
    ("ov", "SELECT model, feature, avg(importance) AS m FROM im GROUP BY ALL"),
    ("od", "SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY m DESC, feature)"
           " AS position FROM ov"),
], f"SELECT role, model, feature, {r('importance')} AS importance, position FROM im"
   " JOIN od USING (model, feature) WHERE position <= 10")
add("dependence_frame", [
    *SCALED, *shap_ctes(["logistic"]), ("lo", shap_rows()),
    ("im", "SELECT role, model, feature, avg(abs(shap)) AS importance FROM lo GROUP BY ALL"),
    ("od", "SELECT role, model, feature, row_number() OVER (PARTITION BY role, model ORDER BY"
           " importance DESC, feature) AS position FROM im"),
], f"SELECT role, model, row_key, feature, {r('feature_value')} AS feature_value,"
   f" {r('shap')} AS shap, position FROM lo JOIN od USING (role, model, feature)"
   " WHERE position <= 5")

# ---- pressure --------------------------------------------------------------------------------


def contexts(player: str) -> list[tuple[str, str]]:
    base = f"row_key, {player} AS player, opponent_team AS opponent, performance_score AS score"
    return [
        *SERIES,
        ("d", f"SELECT pg.*, bo5, final3, {TEAMS} FROM pg JOIN flags USING (game_id)"),
        ("lng", f"SELECT 'playoff' AS context, {base}, CASE WHEN state = 'Playoffs' THEN 1 ELSE 0"
                f" END AS pressure FROM d WHERE state IN ('Playoffs', 'Regular')"
                f" UNION ALL SELECT 'international', {base}, international FROM d"
                f" UNION ALL SELECT 'bo5_final', {base}, CASE WHEN final3 THEN 1 ELSE 0 END FROM d"
                " WHERE bo5"),
    ]


def qualified(player: str, free=("bo5_final",)) -> list[tuple[str, str]]:
    return [
        *contexts(player),
        ("okp", "SELECT context, player, CAST(sum(pressure) AS BIGINT) AS n_pressure,"
                " CAST(sum(1 - pressure) AS BIGINT) AS n_normal FROM lng GROUP BY ALL"
                f" HAVING context IN {text(free)}"
                " OR (sum(pressure) > 0 AND sum(1 - pressure) > 0)"),
        ("rws", "SELECT lng.* FROM lng SEMI JOIN okp USING (context, player)"),
    ]


add("pressure_players", qualified("thin_player"),
    "SELECT context, player, n_pressure, n_normal FROM okp")
add("pressure_datasets", qualified("thin_player"),
    "SELECT context, row_key, player, pressure, score FROM rws")
add("pressure_datasets_literal", qualified("thin_player", ("bo5_final", "playoff")),
    f"SELECT context, pressure, count(*) AS n_rows, {r('sum(score)', 3)} AS score_sum FROM rws"
    " GROUP BY ALL")
add("factor_codes", [
    ("pg", PG),
    ("dm", "SELECT DISTINCT thin_player AS player FROM pg"),
    ("cd", "SELECT player, row_number() OVER (ORDER BY player) AS player_id FROM dm"),
], "SELECT thin_player AS player, row_key, player_id FROM pg JOIN cd ON cd.player = thin_player")
add("clutch_csv", contexts("player"),
    f"SELECT context, pressure, opponent AS opponent_team, count(*) AS n_rows,"
    f" {r('sum(score)', 3)} AS score_sum FROM lng GROUP BY ALL")
add("score_inflation", [
    *contexts("player"),
    ("ag", "SELECT context, pressure, count(*) AS n,"
           " avg(CASE WHEN score IN (0, 1) THEN 1.0 ELSE 0.0 END) AS zoi,"
           " avg(score) FILTER (score IN (0, 1)) AS coi,"
           " avg(score) FILTER (score NOT IN (0, 1)) AS m,"
           " var_pop(score) FILTER (score NOT IN (0, 1)) AS v FROM lng GROUP BY ALL"),
], f"SELECT context, pressure, n, {r('zoi')} AS zoi, {r('coi')} AS coi, {r('m')} AS interior_mean,"
   f" {r('v')} AS interior_var, {r('m * (1 - m) / v - 1')} AS phi FROM ag")



def _gamma_series(x: str, terms: list[float], power: int, head: str, sign: str) -> str:
    z = f"({x} + {GAMMA_SHIFT})"
    series = " + ".join(f"({t!r}) / power({z}, {2 * k + power})" for k, t in enumerate(terms))
    down = " + ".join(f"1 / power({x} + {k}, {power - 1})" for k in range(GAMMA_SHIFT))
    return f"({head.format(z=z)} {sign} ({series}) {sign} ({down}))"


def digamma(x: str) -> str:
    return _gamma_series(x, DIGAMMA_TERMS, 2, "ln({z}) - 0.5 / {z}", "-")


def trigamma(x: str) -> str:
    return _gamma_series(x, TRIGAMMA_TERMS, 3, "1 / {z} + 0.5 / ({z} * {z})", "+")


add("score_beta_fit", [
    *contexts("player"),
    ("ag", "SELECT context, pressure, count(*) AS n, avg(CASE WHEN score IN (0, 1) THEN 1.0 ELSE 0.0 END) AS zoi,"
           " avg(score) FILTER (score IN (0, 1)) AS coi, avg(ln(score)) FILTER (score NOT IN (0, 1)) AS l1,"
           " avg(ln(1 - score)) FILTER (score NOT IN (0, 1)) AS l0, avg(score) FILTER (score NOT IN (0, 1)) AS m,"
           " var_pop(score) FILTER (score NOT IN (0, 1)) AS v FROM lng GROUP BY ALL"),
    ("th", "SELECT context, pressure, 0 AS step, m * (m * (1 - m) / v - 1) AS a, (1 - m) * (m * (1 - m) / v - 1) AS b, 1::DOUBLE AS moved FROM ag"
           " UNION ALL SELECT context, pressure, step + 1, a + da, b + db, greatest(abs(da) / a, abs(db) / b) FROM ("
           "SELECT *, (h0 * g1 + bend * g0) / (h1 * h0 - bend * bend) AS da, (bend * g1 + h1 * g0) / (h1 * h0 - bend * bend) AS db FROM ("
           f"SELECT *, {digamma('(a + b)')} - {digamma('a')} + l1 AS g1, {digamma('(a + b)')} - {digamma('b')} + l0 AS g0,"
           f" {trigamma('(a + b)')} AS bend, {trigamma('a')} - {trigamma('(a + b)')} AS h1, {trigamma('b')} - {trigamma('(a + b)')} AS h0"
           " FROM th JOIN ag USING (context, pressure) WHERE step < 30))"),
], f"SELECT context, pressure, n, {r('zoi', 5)} AS zoi, {r('coi', 5)} AS coi, {r('a / (a + b)', 5)} AS mean, {r('a + b', 5)} AS phi,"
   " moved < 1e-9 AS converged FROM th JOIN ag USING (context, pressure) WHERE step = 30")
ORACLES["score_beta_fit"] = ORACLES["score_beta_fit"].replace("WITH ", "WITH RECURSIVE ", 1)

PHI = "poly"
_poly = " + ".join(f"({a!r}) * power(t, {i + 1})" for i, a in enumerate(ERF_A))


def tau2(source: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"mf_{name}", f"SELECT context, sum(d / v) / sum(1 / v) AS mf, count(d) AS units"
                       f" FROM {source} WHERE d IS NOT NULL GROUP BY context"),
        (f"t_{name}", f"SELECT context, max(units) AS units, greatest(0.0, coalesce((sum((d - mf) *"
                      f" (d - mf) / v) - (max(units) - 1)) / nullif(sum(1 / v) - sum(1 / (v * v)) /"
                      f" sum(1 / v), 0), 0)) AS tau2 FROM {source} JOIN mf_{name} USING (context)"
                      " WHERE d IS NOT NULL GROUP BY context"),
    ]


def fit(player: str, adjusted: bool, p: str = "", shared: bool = False) -> list[tuple[str, str]]:
    """CTEs ``<p>pop``, ``<p>pl`` and ``<p>g`` of one fit; ``shared`` leaves out the input CTEs."""
    ctes = [] if shared else [
        *qualified(player),
        ("sq", "SELECT *, (score * (cnt - 1) + 0.5) / cnt AS y FROM"
               " (SELECT *, count(*) OVER (PARTITION BY context) AS cnt FROM rws)"),
        ("z0", "SELECT *, ln(y / (1 - y)) AS z FROM sq"),
    ]
    src = "z0"
    if adjusted:
        ctes += [
            (f"{p}pm", "SELECT context, player, avg(z) AS pm FROM z0 GROUP BY ALL"),
            (f"{p}g0", "SELECT context, player, pressure, count(*) AS n, var_pop(z) * count(*) AS ss"
                       " FROM z0 GROUP BY ALL"),
            (f"{p}s0", f"SELECT context, sum(ss) / sum(n - 1) AS s2 FROM {p}g0 GROUP BY context"),
            (f"{p}op", f"SELECT context, opponent, avg(z - pm) AS d, max(s2) / count(*) AS v FROM z0"
                       f" JOIN {p}pm USING (context, player) JOIN {p}s0 USING (context)"
                       " GROUP BY ALL"),
            *tau2(f"{p}op", f"{p}op"),
            (f"{p}z1", f"SELECT z0.* EXCLUDE (z), z - d * tau2 / (tau2 + v) AS z FROM z0"
                       f" JOIN {p}op USING (context, opponent) JOIN t_{p}op USING (context)"),
        ]
        src = f"{p}z1"
    return ctes + [
        (f"{p}grp", f"SELECT context, player, pressure, count(*) AS n, avg(z) AS m,"
                  f" var_pop(z) * count(*) AS ss FROM {src} GROUP BY ALL"),
        (f"{p}s2", f"SELECT context, sum(ss) / sum(n - 1) AS s2 FROM {p}grp GROUP BY context"),
        (f"{p}wd", f"SELECT context, player, max(n) FILTER (pressure = 1) AS n1,"
                   f" max(n) FILTER (pressure = 0) AS n0, max(m) FILTER (pressure = 1) AS m1,"
                   f" max(m) FILTER (pressure = 0) AS m0 FROM {p}grp GROUP BY ALL"),
        (f"{p}dv", f"SELECT context, player, m1 - m0 AS d, s2 * (1.0 / n1 + 1.0 / n0) AS v"
                   f" FROM {p}wd JOIN {p}s2 USING (context)"),
        *tau2(f"{p}dv", f"{p}dv"),
        (f"{p}pop", f"SELECT context, sum(d / (v + tau2)) / (sum(1 / (v + tau2)) + 4) AS mu,"
                    f" sqrt(1 / (sum(1 / (v + tau2)) + 4)) AS se, max(tau2) AS tau2,"
                    f" max(units) AS units FROM {p}dv JOIN t_{p}dv USING (context)"
                    " WHERE d IS NOT NULL GROUP BY context"),
        (f"{p}sh", f"SELECT context, player, d, mu, se,"
                   f" CASE WHEN d IS NULL THEN 0 ELSE tau2 / (v + tau2) END AS own,"
                   f" CASE WHEN d IS NULL THEN tau2 ELSE tau2 * v / (v + tau2) END AS ov"
                   f" FROM {p}dv JOIN {p}pop USING (context)"),
        (f"{p}po", f"SELECT *, own * coalesce(d, 0) + (1 - own) * mu AS med,"
                   f" sqrt(ov + (1 - own) * (1 - own) * se * se) AS sd FROM {p}sh"),
        (f"{p}ab", f"SELECT *, abs(med / sd) / sqrt(2.0) AS a,"
                   f" 1 / (1 + {ERF_P!r} * abs(med / sd) / sqrt(2.0)) AS t FROM {p}po"),
        (f"{p}pl", f"SELECT *, med - 1.959964 * sd AS lo, med + 1.959964 * sd AS hi,"
                   f" 0.5 * (1 + sign(med) * (1 - ({_poly}) * exp(-a * a))) AS pr_pos FROM {p}ab"),
    ]


SLOPES = (f"context, player, {r('med', 5)} AS med, {r('lo', 5)} AS lo, {r('hi', 5)} AS hi,"
          f" {r('pr_pos', 5)} AS pr_pos")
add("pressure_slopes", fit("thin_player", False), f"SELECT {SLOPES} FROM pl")
add("pressure_slopes_adjusted", fit("thin_player", True), f"SELECT {SLOPES} FROM pl")

RANKED = ("rkd", "SELECT *, row_number() OVER (PARTITION BY context ORDER BY med, player) AS rank,"
                 " count(*) OVER (PARTITION BY context) AS cnt,"
                 " ntile(10) OVER (PARTITION BY context ORDER BY med, player) AS decile FROM pl")
LABEL = "CASE WHEN rank % 50 = 0 THEN player END AS label"
add("slope_ranks", [*fit("player", False), RANKED], f"SELECT {SLOPES}, rank, {LABEL} FROM rkd")
BOTH = [*fit("thin_player", False), *fit("thin_player", True, "a_", shared=True)]


def effect(p: str, name: str) -> str:
    return (f"{r(f'{p}.mu', 5)} AS {name}_estimate,"
            f" {r(f'{p}.mu - 1.959964 * {p}.se', 5)} AS {name}_lo,"
            f" {r(f'{p}.mu + 1.959964 * {p}.se', 5)} AS {name}_hi, {p}.units AS {name}_players")


add("effect_comparison", BOTH,
    f"SELECT context, {effect('pop', 'baseline')}, {effect('a_pop', 'adjusted')}"
    " FROM pop LEFT JOIN a_pop USING (context)")


def left_out(p: str, src: str) -> list[tuple[str, str]]:
    return [
        (f"{p}lr", f"SELECT context, z, s2, (sum(z) OVER w - z) / nullif(count(*) OVER w - 1, 0) AS"
                   f" other FROM {src} JOIN {p}s2 USING (context)"
                   " WINDOW w AS (PARTITION BY context, player, pressure)"),
        (f"{p}lo", f"SELECT context, count(*) AS n, sum(-0.5 * ln(2 * pi() * s2) - (z - other) *"
                   f" (z - other) / (2 * s2)) AS elpd FROM {p}lr WHERE other IS NOT NULL"
                   " GROUP BY context"),
    ]


add("loo_comparison", [*BOTH, *left_out("", "z0"), *left_out("a_", "a_z1")],
    f"SELECT context, lo.n AS n_scored, {r('lo.elpd', 3)} AS elpd_baseline,"
    f" {r('a_lo.elpd', 3)} AS elpd_adjusted, {r('a_lo.elpd - lo.elpd', 3)} AS gain"
    " FROM lo JOIN a_lo USING (context)")


def uniform(parts: str, word: int) -> str:
    return (f"((('0x' || substr(md5({parts} || '|123'), {8 * word + 1}, 8))::BIGINT + 0.5)"
            " / 4294967296.0)")


def normal(parts: str) -> str:
    return f"sqrt(-2.0 * ln({uniform(parts, 0)})) * cos(2.0 * pi() * {uniform(parts, 1)})"


DRAWS = [
    *fit("player", False),
    ("dn", "SELECT CAST(range AS VARCHAR) AS draw FROM range(1, 4001)"),
    ("pd", f"SELECT context, draw, mu + se * {normal("context || '|' || draw")} AS b_pressure"
           " FROM pop CROSS JOIN dn"),
    ("ud", "SELECT context, draw, player, b_pressure, own * (coalesce(d, 0) - b_pressure)"
           f" + sqrt(ov) * {normal("context || '|' || player || '|' || draw")} AS u1"
           " FROM pl JOIN pd USING (context)"),
]
add("slope_draws", DRAWS,
    f"SELECT context, CAST(draw AS INTEGER) AS draw, {r('max(b_pressure)', 5)} AS b_pressure,"
    f" {r('avg(u1)', 5)} AS mean_u1, {r('min(b_pressure + u1)', 5)} AS lowest,"
    f" {r('max(b_pressure + u1)', 5)} AS highest FROM ud GROUP BY context, draw")


def summarised(source: str, by: str) -> list[tuple[str, str]]:
    return [
        ("su", f"SELECT {by}player, median(beta) AS med, quantile_cont(beta, 0.025) AS lo,"
               f" quantile_cont(beta, 0.975) AS hi, avg(CASE WHEN beta > 0 THEN 1.0 ELSE 0.0 END)"
               f" AS pr_pos FROM {source} WHERE beta IS NOT NULL GROUP BY ALL"),
        ("sr", "SELECT *, row_number() OVER ("
               + (f"PARTITION BY {by.rstrip(', ')} " if by else "")
               + "ORDER BY med, player) AS rank FROM su"),
    ]


add("slope_summary", [*DRAWS, ("bt", "SELECT context, player, b_pressure + u1 AS beta FROM ud"),
                      *summarised("bt", "context, ")],
    f"SELECT {SLOPES}, rank, {LABEL} FROM sr")


def polynomial(x: str, coefficients: list[float]) -> str:
    return " + ".join(f"({c!r}::DOUBLE) * pow({x}, {len(coefficients) - 1 - i})" for i, c in enumerate(coefficients))


# the sequence of pairs of lags ends long before the last lag that is listed here
add("draw_diagnostics", [
    *DRAWS,
    ("hf", "SELECT context, player, CAST(draw AS INTEGER) AS draw, (CAST(draw AS INTEGER) - 1) // 500 AS half, b_pressure + u1 AS x FROM ud"),
    ("md", "SELECT context, player, median(x) AS middle FROM hf GROUP BY ALL"),
    ("kd", "SELECT context, player, half, draw, 'bulk' AS kind, x AS v FROM hf UNION ALL"
           " SELECT context, player, half, draw, 'folded', abs(x - middle) FROM hf JOIN md USING (context, player)"),
    ("rk", "SELECT *, (rank() OVER (PARTITION BY context, player, kind ORDER BY v) + (count(*) OVER (PARTITION BY context, player, kind, v) - 1) / 2.0"
           " - 0.375) / 4000.25 AS p FROM kd"),
    ("tl", "SELECT *, p - 0.5 AS q, pow(p - 0.5, 2) AS q2, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM rk"),
    ("zs", f"SELECT *, CASE WHEN least(p, 1 - p) < {QUANTILE_TAIL} THEN sign(-q) * ({polynomial('t', QUANTILE_C)}) / ({polynomial('t', QUANTILE_D)})"
           f" ELSE q * ({polynomial('q2', QUANTILE_A)}) / ({polynomial('q2', QUANTILE_B)}) END AS z FROM tl"),
    ("ch", "SELECT context, player, kind, half, avg(z) AS mean, var_samp(z) AS variance, list(z ORDER BY draw) AS zl FROM zs GROUP BY ALL"),
    ("mo", "SELECT context, player, kind, avg(variance) AS within, 499 / 500.0 * avg(variance) + var_samp(mean) AS plus FROM ch GROUP BY ALL"),
    ("ce", "SELECT context, player, half, list_transform(zl, lambda z: z - mean) AS zl FROM ch WHERE kind = 'bulk'"),
    ("ac", "SELECT context, player, lag, avg(list_dot_product(zl[1:500 - lag], zl[lag + 1:500]) / 500) AS acov"
           " FROM ce CROSS JOIN (SELECT CAST(range AS INTEGER) AS lag FROM range(0, 80)) GROUP BY ALL"),
    ("pr", "SELECT context, player, lag // 2 AS pair, sum(CASE WHEN lag = 0 THEN 1 ELSE 1 - (within - acov) / plus END) AS p"
           " FROM ac JOIN mo USING (context, player) WHERE kind = 'bulk' GROUP BY ALL"),
    ("op", "SELECT *, min(p) OVER (PARTITION BY context, player ORDER BY pair) AS low FROM pr"),
    ("ta", "SELECT context, player, sum(low) AS sums FROM op WHERE low > 0 GROUP BY ALL"),
    ("rh", "SELECT context, player, max(sqrt(plus / within)) AS rhat FROM mo GROUP BY ALL"),
], "SELECT context, player, 4::BIGINT AS n_chains, 4000::BIGINT AS n_draws,"
   f" {r('rhat', 4)} AS rhat, {r('4000 / greatest(2 * sums - 1, 1 / log10(4000))', 4)} AS ess FROM rh JOIN ta USING (context, player)")
WIDE = [
    ("pg", PG),
    ("rl", "SELECT game_id AS draw, role AS player, avg(performance_score) AS u1 FROM pg"
           " GROUP BY ALL"),
]
add("draws_unpivot", [
    *WIDE,
    ("ga", "SELECT game_id AS draw, avg(performance_score) AS b FROM pg GROUP BY ALL"),
    ("dr", f"SELECT draw, unnest([{', '.join(repr(x) for x in ROLES)}]) AS player, b FROM ga"),
], f"SELECT dr.draw, dr.player, {r('b + u1')} AS beta FROM dr"
   " LEFT JOIN rl ON rl.draw = dr.draw AND rl.player = dr.player")
add("draws_unpivot_summary", [*WIDE, ("bt", "SELECT player, u1 - 0.4567::DOUBLE AS beta FROM rl"),
                              *summarised("bt", "")],
    f"SELECT player, {r('med', 5)} AS med, {r('lo', 5)} AS lo, {r('hi', 5)} AS hi,"
    f" {r('pr_pos', 5)} AS pr_pos, rank, {LABEL} FROM sr".replace(
        f"{r('med', 5)}", r("med")).replace(f"{r('lo', 5)}", r("lo")).replace(
        f"{r('hi', 5)}", r("hi")).replace(f"{r('pr_pos', 5)}", r("pr_pos")))
add("coef_table", [
    *fit("player", True),
    ("cd", "SELECT player, row_number() OVER (ORDER BY player) AS player_id FROM"
           " (SELECT DISTINCT player FROM pg)"),
    ("al", "SELECT row_number() OVER (ORDER BY med, player_id) AS rank, player_id, player AS label,"
           " med, lo, hi, sd FROM pl JOIN cd USING (player) WHERE context = 'international'"
           " UNION ALL SELECT 0, NULL, 'POPULATION AVERAGE', mu, mu - 1.959964 * se,"
           " mu + 1.959964 * se, se FROM pop WHERE context = 'international'"),
], f"SELECT rank, player_id, label, {r('exp(med)', 5)} AS odds_ratio, {r('exp(lo)', 5)} AS or_lo,"
   f" {r('exp(hi)', 5)} AS or_hi, {r('sd', 5)} AS est_error,"
   " printf('%.2f [%.2f, %.2f]', exp(med), exp(lo), exp(hi)) AS summary FROM al")
add("first_game_of_player", [("pg", PG)],
    "SELECT player, game_id, row_key, role, win FROM (SELECT thin_player AS player, game_id,"
    " row_key, role, win, row_number() OVER (PARTITION BY thin_player ORDER BY game_id, row_key)"
    " AS rn FROM pg) WHERE rn = 1")
add("clutch_tiers", [
    *fit("thin_player", False),
    ("ct", "SELECT player, count(*) AS n_contexts, CAST(count_if(med > 0) AS BIGINT) AS n_positive,"
           " CAST(count_if(med > 0 AND pr_pos > 0.75 AND exp(med) > 1.5) AS BIGINT) AS n_clutch,"
           " CAST(count_if(pr_pos < 0.25) AS BIGINT) AS n_negative FROM pl GROUP BY player"),
], "SELECT *, CASE WHEN n_positive >= 2 AND n_clutch = 3 THEN 'elite'"
   " WHEN n_positive >= 2 AND n_clutch > 0 THEN 'clutch' WHEN n_clutch > 0 THEN 'situational'"
   " WHEN n_negative >= 2 THEN 'vulnerable' ELSE 'neutral' END AS tier FROM ct")
_bound = "CASE context WHEN 'bo5_final' THEN 0.8 ELSE 0.7 END"


def share(condition: str) -> str:
    return r(f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)", 5)


add("sensitivity_bands", [*fit("thin_player", False), RANKED],
    f"SELECT context, count(*) AS n_players, {share(f'pr_pos > {_bound}')} AS share_clutch,"
    f" {share(f'pr_pos < 1 - {_bound}')} AS share_sensitive,"
    f" {share(f'pr_pos <= {_bound} AND pr_pos >= 1 - {_bound}')} AS share_stable,"
    f" {r('min(exp(med)) FILTER (decile = 10)', 5)} AS top_or_low,"
    f" {r('max(exp(med)) FILTER (decile = 10)', 5)} AS top_or_high,"
    f" {r('min(exp(med)) FILTER (decile = 1)', 5)} AS bottom_or_low,"
    f" {r('max(exp(med)) FILTER (decile = 1)', 5)} AS bottom_or_high FROM rkd GROUP BY context")

# ---- report ----------------------------------------------------------------------------------


def report_part(source: str, section: str, item: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {item} AS item, '{n}' AS name,"
        f" {r(f'CAST({n} AS DOUBLE)')} AS value FROM {source}" for n in names)


add("report_rows", [
    *SERIES, *FEATURE_ROWS[1:], *ROLE_ROWS[2:], *BEST,
    ("su", SUMMARY),
    ("rs", "SELECT role, count(*) AS n_samples, avg(win) AS win_rate FROM rr GROUP BY role"),
], " UNION ALL ".join([
    report_part("su", "dataset", "'all'", ["player_rows", "games", "bo5_player_rows", "bo5_games",
                                           "final3_player_rows", "final3_games"]),
    report_part("rs", "roles", "role", ["n_samples", "win_rate"]),
    report_part("best", "models", "role || ': ' || model", ["accuracy", "f1_score", "auc_roc"]),
]))

# ---- models: what is known without fitting anything --------------------------------------------

SPLIT = [
    *ROLE_ROWS,
    ("sp", f"SELECT *, row_number() {STRATUM} <= round(0.2 * count(*)"
           " OVER (PARTITION BY role, win)) AS is_test FROM rr"),
    ("ts", "SELECT * FROM sp WHERE is_test"),
    ("tr", "SELECT role, count(*) AS n_train FROM sp WHERE NOT is_test GROUP BY role"),
]
FAMILY = f"(SELECT unnest({MODELS!r}) AS model)"
for _name, _family in zip(["lr", "rf", "gbt", "mlp"], MODELS, strict=True):
    add(f"search_{_name}", SPLIT,
        f"SELECT role, '{_family}' AS model, n_train, 2 AS n_searched, true AS best_chosen,"
        " true AS cv_auc_sound, true AS log_loss_sound, true AS metrics_sound FROM tr")
add("evaluate_models", [
    *SPLIT,
    ("n", "SELECT role, count(*) FILTER (win = 0) AS n0, count(*) FILTER (win = 1) AS n1 FROM ts"
          " GROUP BY role"),
], " UNION ALL ".join(
    f"SELECT role, model, '{c}' AS class, CAST({v} AS DOUBLE) AS support, true AS sound"
    f" FROM n CROSS JOIN {FAMILY}"
    for c, v in (("0", "n0"), ("1", "n1"), ("macro avg", "n0 + n1"), ("weighted avg", "n0 + n1"))))
SPECS = {
    "logistic": {"penalty": "l2", "C": "1.0", "max_iter": "20"},
    "random_forest": {"n_estimators": "10", "max_depth": "5", "trees": "10", "depth": "5"},
    "xgboost": {"n_estimators": "8", "max_depth": "3", "learning_rate": "0.2", "trees": "8",
                "depth": "3"},
    "neural_network": {
        "n_neurons": "10", "n_hidden": "1", "epochs": "20", "layers": "11-10-2",
        "total_params": "142", "trainable_params": "142", "non_trainable_params": "0",
        "solver": "l-bfgs", "loss": "cross entropy"},
}
NONE = {"logistic": ["solver"], "random_forest": ["min_samples_split"],
        "xgboost": ["reg_alpha", "reg_lambda"],
        "neural_network": ["learning_rate", "optimizer", "dropout", "activation"]}
_specs = ", ".join(
    f"('{f}', '{k}', '{v}')" for f in MODELS
    for k, v in [*SPECS[f].items(), *[(k, "no counterpart") for k in NONE[f]]])
add("model_specs", SPLIT,
    f"SELECT family, role, setting, value FROM tr CROSS JOIN (VALUES {_specs}) v(family, setting, value)"
    f" UNION ALL SELECT model, role, 'n_train', CAST(n_train AS VARCHAR) FROM tr CROSS JOIN {FAMILY}")
add("batch_predict", [("pg", PG)],
    "SELECT row_key AS player_id, CASE WHEN slot <> 7 THEN role END AS role, slot <> 7 AS scored,"
    " CASE WHEN slot <> 7 THEN true END AS consistent FROM pg")
add("stored_linear_score", SPLIT,
    "SELECT role, row_key, win AS label, true AS equal FROM ts")
add("model_roundtrip", SPLIT,
    "SELECT role, CAST(sum(c * c) AS BIGINT) AS n, 0.0::DOUBLE AS largest_difference FROM"
    " (SELECT role, row_key, count(*) AS c FROM ts GROUP BY ALL) GROUP BY role")
add("single_player_scores", [*SPLIT, ("sm", sampled("ts", 1))],
    "SELECT role, row_key, true AS equal FROM sm")
add("stored_model_inventory", [
    ("gr", f"SELECT unnest({[x.lower() for x in ROLES]!r}) AS role"),
], "SELECT role, model AS model_type, role || '/' || model AS file_path, true AS available,"
   f" true AS sized FROM gr CROSS JOIN {FAMILY}")
add("tree_shapley", [
    *SPLIT, ("n", "SELECT role, least(100, count(DISTINCT row_key)) AS n_rows FROM ts GROUP BY role"),
], "SELECT role, model, n_rows, true AS adds_up FROM n CROSS JOIN"
   " (SELECT unnest(['random_forest', 'xgboost']) AS model)")
add("full_run", [
    *SERIES, *FEATURE_ROWS[1:], *ROLE_ROWS[2:],
    ("su", SUMMARY),
    ("rs", "SELECT role, count(*) AS n_samples, avg(win) AS win_rate FROM rr GROUP BY role"),
    ("md", "SELECT role, 1.0 AS accuracy, 1.0 AS f1_score, 1.0 AS auc_roc FROM rs"),
], " UNION ALL ".join([
    report_part("su", "dataset", "'all'", ["player_rows", "games", "bo5_player_rows", "bo5_games",
                                           "final3_player_rows", "final3_games"]),
    report_part("rs", "roles", "role", ["n_samples", "win_rate"]),
    report_part("md", "models", "role", ["accuracy", "f1_score", "auc_roc"]),
]))
