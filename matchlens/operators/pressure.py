"""How a player's score changes under pressure, with partial pooling over players.

The fit is a closed-form empirical-Bayes normal model on the logit scale: raw per-player slopes
are shrunk towards the population effect by their noise. It approximates a full Bayesian
hierarchical fit; all of it is grouped sums, so it runs as ordinary aggregations. Player rows are
reduced on the map side, to one row per player or, with opponents, to (player, opponent, condition)
cells, and everything else works on those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlens.functions.numeric import Z_975, digamma, hash_normal, normal_cdf, squeeze_logit, trigamma
from matchlens.functions.text import interval_text, player_from_parameter, population_label
from matchlens.operators.joins import salted_join
from matchlens.operators.ordered import ntile_of, ranked
from matchlens.schema import CONTEXTS
from matchlens.sources.storage import pinned, pinned_by, sized

# --- fixed values -----------------------------------------------------------
PRIOR_SD = 0.5          # prior standard deviation of the population effect
N_DRAWS = 4000          # 4 chains x (2000 - 1000) kept iterations
SEED = 123
LABEL_EVERY = 50
CLUTCH_PROBABILITY = 0.75
CLUTCH_ODDS_RATIO = 1.5
CLUTCH_CONTEXTS = 2
BAND_PROBABILITY = {"playoff": 0.7, "international": 0.7, "bo5_final": 0.8}
# ----------------------------------------------------------------------------

#: Contexts in which only players seen in both conditions count.
BOTH_CONDITIONS = ("playoff", "international")

PLAYER = ["context", "player"]
#: Players of a task that draws: beyond 128 keys an aggregate of values or sketches sorts its rows, and a player has four chains.
SPREAD_ROWS = 20
#: Fisher scoring steps of a beta fit; from moments about ten bring it to rounding.
BETA_STEPS = 30


# ---- the three pressure data sets ------------------------------------------------------------


def pressure_rows(d: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All three contexts in one frame from one scan: ``context, player, pressure, score``.

    Playoff: playoff against regular games. International: international against domestic games.
    Bo5 final: the last three games of a long series against its earlier ones.
    """

    def entry(name: str, pressure: Column) -> Column:
        return F.struct(F.lit(name).alias("context"), pressure.cast("int").alias("pressure"))

    memberships = F.array(
        F.when(
            F.col("state").isin("Playoffs", "Regular"),
            entry("playoff", F.col("state") == "Playoffs"),
        ),
        F.when(F.col("international").isNotNull(), entry("international", F.col("international"))),
        F.when(F.col("bo5"), entry("bo5_final", F.col("final3"))),
    )
    # laid out whole and filtered after it: a filter inside the array is not compiled
    laid_out = d.select(
        F.inline(memberships).alias("__context", "__pressure"), "player", F.col("performance_score").alias("score"), *(keep or [])
    )
    kept = [F.col(f"`{c}`") for c in keep or []]
    return laid_out.where(F.col("__context").isNotNull()).select(
        F.col("__context").alias("context"), "player", F.col("__pressure").alias("pressure"), "score", *kept
    )


def condition_counts(rows: DataFrame) -> DataFrame:
    """Games with and without pressure per context and player."""
    return rows.groupBy(*PLAYER).agg(
        F.count_if(F.col("pressure") == 1).alias("n_pressure"),
        F.count_if(F.col("pressure") == 0).alias("n_normal"),
    )


def qualifies(
    contexts: tuple[str, ...] = BOTH_CONDITIONS, n1="n_pressure", n0="n_normal"
) -> Column:
    """Seen in both conditions, where the context asks for it."""
    both = (F.col(n1) > 0) & (F.col(n0) > 0)
    return both | ~F.col("context").isin(*contexts) if contexts else F.lit(True)


def pressure_datasets(
    rows: DataFrame, spread: list[str], require_both: tuple[str, ...] = BOTH_CONDITIONS
) -> DataFrame:
    """Player rows of the contexts without players that lack one of the two conditions.

    ``require_both=("international",)`` gives the reading in which the playoff data set is not
    filtered. A player with a large share of all rows is split over several tasks.
    """
    kept = condition_counts(rows).where(qualifies(require_both)).select(*PLAYER)
    return salted_join(rows, kept, PLAYER, "left_semi", spread=spread)


def score_inflation(rows: DataFrame) -> DataFrame:
    """Shares of exact 0 and 1, and mean and precision of the scores between them."""
    y = F.col("score")
    edge = (y == 0) | (y == 1)
    inner = F.when(~edge, y)
    sums = rows.groupBy("context", "pressure").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(edge.cast("double")).alias("zoi"),
        F.avg(F.when(edge, y)).alias("coi"),
        F.avg(inner).alias("interior_mean"),
        F.var_pop(inner).alias("interior_var"),
    )
    m, v = F.col("interior_mean"), F.col("interior_var")
    return sums.withColumn("phi", F.try_divide(m * (1 - m), v) - 1)


def beta_fit(rows: DataFrame, by: list[str] | None = None, score: str = "score", steps: int = BETA_STEPS) -> DataFrame:
    """Zero-one-inflated beta of the scores of every cell, by maximum likelihood.

    ``zoi`` is the share of exact 0 and 1, ``coi`` the share of 1 among these; ``mean`` and ``phi`` (precision)
    belong to the scores between them. One aggregation leaves n, the sums of ln y and ln(1 - y) and the
    moments of a cell; Fisher scoring from the moments then runs on that row, `steps` times, each step cut to
    a fivefold change. ``moved`` is the last step's relative change. Cells whose inner scores do not vary
    have no fit: mean, phi and moved are NULL. Scores outside [0, 1] and null ones are left out.
    """
    by = by or ["context", "pressure"]
    y = F.col(score)
    inner = F.when((y > 0) & (y < 1), y)
    cells = rows.where(y.between(0, 1)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inner.isNull().cast("double")).alias("zoi"), F.avg(F.when(inner.isNull(), y)).alias("coi"),
        F.avg(F.log(inner)).alias("__l1"), F.avg(F.log1p(-inner)).alias("__l0"), F.avg(inner).alias("__m"), F.var_pop(inner).alias("__v"),
    )
    phi = F.try_divide(F.col("__m") * (1 - F.col("__m")), F.when(F.col("__v") > 0, F.col("__v"))) - 1
    start = F.struct((F.col("__m") * phi).alias("a"), ((1 - F.col("__m")) * phi).alias("b"), F.lit(None).cast("double").alias("moved"))

    def step(at: Column, _: Column) -> Column:
        a, b = at["a"], at["b"]
        both, bend = digamma(a + b), trigamma(a + b)
        g1, g0 = both - digamma(a) + F.col("__l1"), both - digamma(b) + F.col("__l0")
        h1, h0 = trigamma(a) - bend, trigamma(b) - bend
        det = h1 * h0 - bend * bend
        new_a = F.greatest(a / 5, F.least(a * 5, a + F.try_divide(h0 * g1 + bend * g0, det)))
        new_b = F.greatest(b / 5, F.least(b * 5, b + F.try_divide(bend * g1 + h1 * g0, det)))
        return F.struct(new_a.alias("a"), new_b.alias("b"), F.greatest(F.abs(new_a - a) / a, F.abs(new_b - b) / b).alias("moved"))

    fitted = cells.withColumn("__f", F.when(phi > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)))
    a, b = F.col("__f.a"), F.col("__f.b")
    return fitted.select(*by, "n", "zoi", "coi", (a / (a + b)).alias("mean"), (a + b).alias("phi"), F.col("__f.moved").alias("moved"))


# ---- the fit ---------------------------------------------------------------------------------


@dataclass
class PressureFit:
    """``players``: one row per context and player. ``population``: one per context.
    ``groups``: n and sum of squares per context, player and condition."""

    players: DataFrame
    population: DataFrame
    groups: DataFrame


def _with_logit(rows: DataFrame, require_both: tuple[str, ...]) -> DataFrame:
    """Rows with the context's number of rows and the logit score ``z`` that it squeezes."""
    n_rows = (
        condition_counts(rows)
        .where(qualifies(require_both))
        .groupBy("context")
        .agg(F.sum(F.col("n_pressure") + F.col("n_normal")).alias("n_context"))
    )
    return rows.join(_per_context(n_rows), "context").withColumn("z", squeeze_logit(F.col("score"), F.col("n_context")))


def _cells(rows: DataFrame, require_both: tuple[str, ...], opponent: str) -> DataFrame:
    """Moments of the logit score per context, player, condition and opponent, stored by player.

    ``pm`` is the player's mean. A player has at most two cells per opponent, so the window over a
    player's cells stays small however many rows the player has. Cells meet by player in as many
    tasks as the table has buckets, so that each of these is one file.
    """
    moments = (
        _with_logit(rows, require_both)
        .groupBy(*PLAYER, "pressure", F.col(opponent).alias("opponent"))
        .agg(
            F.count("z").alias("n"),
            F.sum("z").alias("s1"),
            F.sum(F.col("z") * F.col("z")).alias("s2"),
            F.max("n_context").alias("n_context"),
        )
    )
    own = W.partitionBy(*PLAYER)
    n_in = {p: F.sum(F.when(F.col("pressure") == p, F.col("n")).otherwise(0)).over(own)
            for p in (0, 1)}
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = moments.repartition(buckets, *PLAYER).select(
        "*",
        n_in[1].alias("n_pressure"),
        n_in[0].alias("n_normal"),
        (F.sum("s1").over(own) / F.sum("n").over(own)).alias("pm"),
    )
    return pinned_by(cells.where(qualifies(require_both)).drop("n_pressure", "n_normal"), PLAYER, "cells")


def _by_condition(df: DataFrame, n: Column, s1: Column, s2: Column) -> DataFrame:
    """One row per context and player with n, sum and sum of squares of both conditions side by side.

    Rows of neither condition have columns of their own (``n2``, ...). A condition without rows has nulls.
    """
    under = F.col("pressure")
    which = {0: under == 0, 1: under == 1, 2: ~F.coalesce(under.isin(0, 1), F.lit(False))}
    sums = [F.sum(F.when(w, v)).alias(f"{name}{k}") for k, w in which.items() for name, v in (("n", n), ("p", s1), ("q", s2))]
    return df.groupBy(*PLAYER).agg(*sums, F.max("n_context").alias("n_context"))


def player_moments(rows: DataFrame, require_both: tuple[str, ...] = BOTH_CONDITIONS) -> DataFrame:
    """Moments of the logit score by condition, a row per context and player, from rows without opponents."""
    z = F.col("z")
    wide = _by_condition(_with_logit(rows, require_both), z.isNotNull().cast("long"), z, z * z)
    n1, n0 = (F.coalesce(n, F.lit(0)) for n in ("n1", "n0"))
    return wide.withColumns({"__n1": n1, "__n0": n0}).where(qualifies(require_both, "__n1", "__n0")).drop("__n1", "__n0")


def _cell_moments(cells: DataFrame) -> DataFrame:
    """The same from cells: these lie by player, so nothing is shuffled."""
    return _by_condition(cells, F.col("n"), F.col("s1"), F.col("s2"))


def _groups(moments: DataFrame) -> DataFrame:
    """Players' rows to (context, player, condition): n, mean, sum of squares about the mean."""
    by_condition = F.array(*[
        F.struct(F.lit(k if k < 2 else None).cast("int").alias("pressure"), *[F.col(f"{c}{k}").alias(f"__{c}") for c in "npq"]) for k in range(3)
    ])
    n, p, q = (F.col(f"__{c}") for c in "npq")
    return moments.select(*PLAYER, F.inline(by_condition), "n_context").where(n.isNotNull()).select(
        *PLAYER, "pressure", n.alias("n"), (p / n).alias("mean"), F.greatest(F.lit(0.0), q - p * p / n).alias("ss"), "n_context"
    )


def _residual_variance(groups: DataFrame) -> DataFrame:
    """Pooled variance within (player, condition) per context; three rows."""
    return groups.groupBy("context").agg(
        F.try_divide(F.sum("ss"), F.sum(F.col("n") - 1)).alias("s2"),
        F.max("n_context").alias("n_rows"),
    )


def _between_variance(estimates: DataFrame) -> DataFrame:
    """DerSimonian-Laird variance between the true effects behind ``d`` with noise ``v``.

    Per context: the number of units, the fixed-weight mean and ``tau2``.
    """
    w, d = F.try_divide(F.lit(1.0), F.col("v")), F.col("d")
    sums = estimates.where(F.col("d").isNotNull()).groupBy("context").agg(
        F.count("d").alias("units"),
        F.sum(w).alias("w1"),
        F.sum(w * w).alias("w2"),
        F.sum(w * d).alias("wd"),
        F.sum(w * d * d).alias("wdd"),
    )
    q = F.col("wdd") - F.col("wd") * F.col("wd") / F.col("w1")
    spread = F.col("w1") - F.col("w2") / F.col("w1")
    return sums.select(
        "context",
        "units",
        F.greatest(
            F.lit(0.0), F.coalesce(F.try_divide(q - (F.col("units") - 1), spread), F.lit(0.0))
        ).alias("tau2"),
    )


def _per_context(df: DataFrame) -> DataFrame:
    """A table of one row per context, for broadcast while it is as small as it should be."""
    return sized(df, limit=10_000)


def _adjust_for_opponent(cells: DataFrame, moments: DataFrame) -> DataFrame:
    """Cells of the score minus the shrunken opponent effect; ``moments`` are the players' without adjustment.

    The opponent effect is the mean residual of the rows against it (score minus player mean),
    shrunk by its own between/within variance. Only cells are joined: a team that a third of all
    rows played against still has at most two cells per player.
    """
    s2 = _residual_variance(_groups(moments)).select("context", "s2")
    effect = (
        cells.groupBy("context", "opponent")
        .agg(
            (F.sum(F.col("s1") - F.col("n") * F.col("pm")) / F.sum("n")).alias("d"),
            F.sum("n").alias("n_opp"),
        )
        .join(_per_context(s2), "context")
        .withColumn("v", F.col("s2") / F.col("n_opp"))
    )
    shrunk = sized(effect.join(_per_context(_between_variance(effect)), "context").select(
        "context",
        "opponent",
        F.coalesce(
            F.try_divide(F.col("d") * F.col("tau2"), F.col("tau2") + F.col("v")), F.lit(0.0)
        ).alias("a"),
    ))
    n, a = F.col("n"), F.col("a")
    return cells.join(shrunk, ["context", "opponent"]).select(
        *PLAYER,
        "pressure",
        "opponent",
        "n",
        (F.col("s1") - n * a).alias("s1"),
        (F.col("s2") - 2 * a * F.col("s1") + n * a * a).alias("s2"),
        "n_context",
    )


def fit_pressure(
    rows: DataFrame,
    opponent: str | None = None,
    require_both: tuple[str, ...] = BOTH_CONDITIONS,
    prior_sd: float = PRIOR_SD,
) -> PressureFit:
    """Partially pooled pressure slopes per context; with ``opponent`` adjusted for that column.

    A player seen in one condition only (where the context allows it) has no slope of its own and
    gets the population effect with the between-player variance added. ``rows`` is read twice, for
    the row counts and for the moments, so pass a stored table.
    """
    if not opponent:
        return _fit_moments(pinned(player_moments(rows, require_both), "moments"), prior_sd)
    cells = _cells(rows, require_both, opponent)
    adjusted = _adjust_for_opponent(cells, _cell_moments(cells))
    return _fit_moments(pinned(_cell_moments(adjusted), "moments"), prior_sd)


def fit_both(
    rows: DataFrame,
    opponent: str,
    require_both: tuple[str, ...] = BOTH_CONDITIONS,
    prior_sd: float = PRIOR_SD,
) -> tuple[PressureFit, PressureFit]:
    """The fit without and with opponent adjustment, from one table of cells."""
    cells = _cells(rows, require_both, opponent)
    moments = pinned(_cell_moments(cells), "moments")
    adjusted = pinned(_cell_moments(_adjust_for_opponent(cells, moments)), "moments")
    return _fit_moments(moments, prior_sd), _fit_moments(adjusted, prior_sd)


def _fit_moments(moments: DataFrame, prior_sd: float) -> PressureFit:
    """The fit from the stored rows of the players; every pass reads these alone."""
    groups = _groups(moments)
    within = _per_context(_residual_variance(groups))
    raw = moments.join(within, "context").select(
        *PLAYER,
        F.coalesce("n0", F.lit(0)).alias("n_normal"),
        F.coalesce("n1", F.lit(0)).alias("n_pressure"),
        (F.col("p1") / F.col("n1") - F.col("p0") / F.col("n0")).alias("d"),
        (F.col("s2") * (1 / F.col("n1") + 1 / F.col("n0"))).alias("v"),
    )
    tau = _per_context(_between_variance(raw))
    w = F.try_divide(F.lit(1.0), F.col("v") + F.col("tau2"))
    pooled = (
        raw.where(F.col("d").isNotNull())
        .join(tau, "context")
        .groupBy("context")
        .agg(F.sum(w).alias("w"), F.sum(w * F.col("d")).alias("wd"))
    )
    precision = F.col("w") + (0.0 if math.isinf(prior_sd) else 1 / prior_sd**2)
    population = _per_context(
        pooled.join(tau, "context")
        .join(within, "context")
        .select(
            "context",
            (F.col("wd") / precision).alias("mu"),
            F.sqrt(1 / precision).alias("se"),
            "tau2",
            "s2",
            F.col("units").alias("n_slopes"),
            "n_rows",
        )
    ).withColumns(
        {"lo": F.col("mu") - Z_975 * F.col("se"), "hi": F.col("mu") + Z_975 * F.col("se")}
    )

    v, tau2 = F.col("v"), F.col("tau2")
    own = F.coalesce(F.try_divide(tau2, v + tau2), F.lit(0.0))
    noise = F.when(F.col("d").isNull(), tau2).otherwise(own * v)
    mean = F.col("own_weight") * F.coalesce("d", F.lit(0.0)) + (
        1 - F.col("own_weight")
    ) * F.col("mu")
    pull = 1 - F.col("own_weight")
    players = (
        raw.join(population.select("context", "mu", "se", "tau2"), "context")
        .withColumns({"own_weight": own, "own_var": noise})
        .withColumn("mean", mean)
        .withColumn("sd", F.sqrt(F.col("own_var") + pull * pull * F.col("se") * F.col("se")))
        .select(
            *PLAYER,
            "n_normal",
            "n_pressure",
            "d",
            "own_weight",
            "own_var",
            "mu",
            "se",
            F.col("mean").alias("med"),
            "sd",
            (F.col("mean") - Z_975 * F.col("sd")).alias("lo"),
            (F.col("mean") + Z_975 * F.col("sd")).alias("hi"),
            normal_cdf(F.col("mean") / F.col("sd")).alias("pr_pos"),
        )
    )
    return PressureFit(players, population, groups)


# ---- draws and their summary -----------------------------------------------------------------


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """A table over tasks by key, before each of its rows is multiplied by the draws.

    The number of tasks grows with the rows, so that a task's draws, and the keys whose values are
    gathered in it, stay as few however many players there are.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-df.count() // SPREAD_ROWS)), *keys)


def _normal(*parts: str, seed: int) -> Column:
    return hash_normal(*[F.col(p).cast("string") for p in parts], F.lit(str(seed)))


def population_draws(fit: PressureFit, n_draws: int = N_DRAWS, seed: int = SEED) -> DataFrame:
    """``context, draw, b_pressure``: draws of the population effect."""
    return (
        fit.population.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
        .withColumn("b_pressure", F.col("mu") + F.col("se") * _normal("context", "draw", seed=seed))
        .select("context", "draw", "b_pressure")
    )


def player_draws(
    fit: PressureFit, population: DataFrame, n_draws: int = N_DRAWS, seed: int = SEED
) -> DataFrame:
    """``context, draw, player, b_pressure, u1``: each player's deviation from the population
    effect of the same draw (``population``, one row per context and draw).

    Uniforms come from hashes of context, player and draw, so the draws do not depend on how the
    rows are partitioned. The rows stay partitioned by context and player.
    """
    own = F.col("own_weight")
    players = _spread(fit.players.select(*PLAYER, "d", "own_weight", "own_var"), PLAYER)
    return (
        players.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
        .join(sized(population), ["context", "draw"])
        .withColumn(
            "u1",
            own * (F.coalesce(F.col("d"), F.lit(0.0)) - F.col("b_pressure"))
            + F.sqrt("own_var") * _normal("context", "player", "draw", seed=seed),
        )
        .select("context", "draw", "player", "b_pressure", "u1")
    )


def draws_from_wide(wide: DataFrame, ids: list[str]) -> DataFrame:
    """One column per player (``r_player_id[<player>,pressure]``) to rows ``ids, player, u1``."""
    columns = [
        c for c in wide.columns if c.startswith("r_player_id[") and c.endswith(",pressure]")
    ]
    values = [F.col(f"`{c}`") for c in columns]
    return wide.unpivot(ids, values, "parameter", "u1").select(
        *ids, player_from_parameter("parameter").alias("player"), "u1"
    )


def total_slopes(
    player: DataFrame, population: DataFrame | None = None, on: list[str] | None = None
) -> DataFrame:
    """``beta = b_pressure + u1`` by draw; ``population`` brings the population draws when the
    player rows do not carry them, joined on the draw's key."""
    rows = player if population is None else player.join(population, on)
    return rows.withColumn("beta", F.col("b_pressure") + F.col("u1"))


def summarise_slopes(
    betas: DataFrame, by: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Median, 95 % interval and share above zero of ``beta`` per player, ranked by median.

    Exact percentiles hold one player's draws; ``approximate`` is for very many draws.
    """
    by = by or []
    at = [0.025, 0.5, 0.975]
    points = (
        F.percentile_approx("beta", at, 10_000)
        if approximate
        else F.percentile("beta", F.array(*[F.lit(p) for p in at]))
    )
    # nulls fall out of the aggregates: a filter on beta would work out every draw a second time
    summary = (
        betas.groupBy(*by, "player")
        .agg(points.alias("p"), F.avg((F.col("beta") > 0).cast("double")).alias("pr_pos"))
        .where(F.col("p").isNotNull())
        .select(
            *by,
            "player",
            F.col("p")[1].alias("med"),
            F.col("p")[0].alias("lo"),
            F.col("p")[2].alias("hi"),
            "pr_pos",
        )
    )
    # ranking samples its input first, which would draw everything again
    return rank_slopes(pinned(summary, "slopes"), by)


def rank_slopes(slopes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank by median (ties by name); every fiftieth rank carries the player's name as label."""
    return ranked(slopes, ["med", "player"], by or []).withColumn(
        "label", F.when(F.col("rank") % LABEL_EVERY == 0, F.col("player"))
    )


# ---- tables ----------------------------------------------------------------------------------


def factor_codes(rows: DataFrame, column: str = "player", code: str = "player_id") -> DataFrame:
    """The distinct values of a column with codes from 1 in sorted order."""
    return ranked(rows.select(column).distinct(), [column], name=code)


def with_codes(
    rows: DataFrame, codes: DataFrame, spread: list[str], column: str = "player"
) -> DataFrame:
    return salted_join(rows, codes, [column], "left", spread=spread)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key along ``order``, by a map-side aggregate."""
    return (
        df.groupBy(*key)
        .agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__r"))
        .select("__r.*")
    )


def coefficient_rows(fit: PressureFit, codes: DataFrame, context: str) -> DataFrame:
    """Player effects by rank with the population row at rank 0, as odds ratios with text."""
    here = fit.players.where(F.col("context") == context).join(codes, "player")
    players = ranked(
        here.select("player_id", "med", "sd", "lo", "hi"), ["med", "player_id"]
    )
    average = fit.population.where(F.col("context") == context).select(
        F.col("mu").alias("med"), F.col("se").alias("sd"), "lo", "hi",
        F.lit(0).cast("long").alias("rank"),
    )
    both = players.unionByName(average, allowMissingColumns=True)
    named = both.join(codes, "player_id", "left")
    return named.select(
        "rank",
        "player_id",
        population_label("player").alias("label"),
        F.exp("med").alias("odds_ratio"),
        F.exp("lo").alias("or_lo"),
        F.exp("hi").alias("or_hi"),
        F.col("sd").alias("est_error"),
        interval_text(F.exp("med"), F.exp("lo"), F.exp("hi")).alias("summary"),
    )


def effect_comparison(baseline: PressureFit, adjusted: PressureFit) -> DataFrame:
    """Population estimate and interval per context, baseline next to opponent-adjusted."""

    def side(fit: PressureFit, name: str) -> DataFrame:
        return fit.population.select(
            "context",
            F.col("mu").alias(f"{name}_estimate"),
            F.col("lo").alias(f"{name}_lo"),
            F.col("hi").alias(f"{name}_hi"),
            F.col("n_slopes").alias(f"{name}_players"),
        )

    return side(baseline, "baseline").join(side(adjusted, "adjusted"), "context", "left")


def loo_score(fit: PressureFit) -> DataFrame:
    """Sum of leave-one-out log densities per context.

    Leaving a row out moves its group's mean so that the row's error is ``n / (n - 1)`` times its
    deviation; the sum over the group therefore follows from its n and sum of squares. Groups of
    one row have nothing to predict from and are left out.
    """
    n = F.col("n")
    scale = n / (n - 1)
    density = -n / 2 * F.log(2 * math.pi * F.col("s2")) - scale * scale * F.col("ss") / (
        2 * F.col("s2")
    )
    return (
        fit.groups.where(n > 1)
        .join(_per_context(fit.population.select("context", "s2")), "context")
        .groupBy("context")
        .agg(F.sum(n).alias("n_scored"), F.sum(density).alias("elpd"))
    )


def loo_comparison(baseline: PressureFit, adjusted: PressureFit) -> DataFrame:
    """Baseline and adjusted score per context; positive ``gain`` favours the adjustment."""
    a = loo_score(baseline).select("context", "n_scored", F.col("elpd").alias("elpd_baseline"))
    b = loo_score(adjusted).select("context", F.col("elpd").alias("elpd_adjusted"))
    return a.join(b, "context").withColumn(
        "gain", F.col("elpd_adjusted") - F.col("elpd_baseline")
    )


def clutch_tiers(slopes: DataFrame) -> DataFrame:
    """Per player over the contexts: positive effects, full clutch criteria, and the tier."""
    positive = F.col("med") > 0
    sure = (F.col("pr_pos") > CLUTCH_PROBABILITY) & (F.exp("med") > CLUTCH_ODDS_RATIO)
    counts = slopes.groupBy("player").agg(
        F.count(F.lit(1)).alias("n_contexts"),
        F.count_if(positive).alias("n_positive"),
        F.count_if(positive & sure).alias("n_clutch"),
        F.count_if(F.col("pr_pos") < 1 - CLUTCH_PROBABILITY).alias("n_negative"),
    )
    consistent = F.col("n_positive") >= CLUTCH_CONTEXTS
    return counts.withColumn(
        "tier",
        F.when(consistent & (F.col("n_clutch") == len(CONTEXTS)), "elite")
        .when(consistent & (F.col("n_clutch") > 0), "clutch")
        .when(F.col("n_clutch") > 0, "situational")
        .when(F.col("n_negative") >= CLUTCH_CONTEXTS, "vulnerable")
        .otherwise("neutral"),
    )


def sensitivity_bands(slopes: DataFrame) -> DataFrame:
    """Shares of players with a likely positive, likely negative and small effect per context,
    and the odds-ratio range of the top and bottom tenth."""
    bound = F.coalesce(
        *[F.when(F.col("context") == c, F.lit(p)) for c, p in BAND_PROBABILITY.items()]
    )
    tenth = ranked(slopes, ["med", "player"], ["context"], name="rk", count="n_ranked").withColumn(
        "decile", ntile_of("rk", "n_ranked", 10)
    )
    orr = F.exp("med")
    top, bottom = F.col("decile") == 10, F.col("decile") == 1
    return tenth.groupBy("context").agg(
        F.count(F.lit(1)).alias("n_players"),
        F.avg((F.col("pr_pos") > bound).cast("double")).alias("share_clutch"),
        F.avg((F.col("pr_pos") < 1 - bound).cast("double")).alias("share_sensitive"),
        F.avg(
            ((F.col("pr_pos") <= bound) & (F.col("pr_pos") >= 1 - bound)).cast("double")
        ).alias("share_stable"),
        F.min(F.when(top, orr)).alias("top_or_low"),
        F.max(F.when(top, orr)).alias("top_or_high"),
        F.min(F.when(bottom, orr)).alias("bottom_or_low"),
        F.max(F.when(bottom, orr)).alias("bottom_or_high"),
    )
