from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from matchlens.functions.numeric import normal_cdf, squeeze_logit
from matchlens.functions.text import interval_text, player_from_parameter
from matchlens.operators import pressure as P

SCHEMA = "context string, player string, opponent string, pressure int, score double"


def rows(spark, spec, context="playoff"):
    data = [(context, p, f"o{i % 3}", c, s) for p, c, scores in spec for i, s in enumerate(scores)]
    return spark.createDataFrame(data, SCHEMA)


SPREAD = [
    ("a", 1, [0.9, 0.95, 0.85, 0.9]), ("a", 0, [0.2, 0.3, 0.25, 0.2]),
    ("b", 1, [0.1, 0.2, 0.15, 0.1]), ("b", 0, [0.8, 0.9, 0.85, 0.7]),
    ("c", 1, [0.5, 0.6, 0.4, 0.5]), ("c", 0, [0.5, 0.45, 0.55, 0.5]),
    ("once", 1, [0.5, 0.6]),
]


def test_contexts_and_their_players(spark):
    schema = ("player string, state string, international int, bo5 boolean, final3 boolean,"
              " performance_score double")
    data = [("a", "Playoffs", 1, True, True, 0.5), ("a", "Regular", 0, True, False, 0.4),
            ("b", "Regular", 0, False, False, 0.3), ("b", "Preseason", None, None, None, 0.2)]
    long = P.pressure_rows(spark.createDataFrame(data, schema))
    got = sorted((r.context, r.player, r.pressure) for r in long.collect())
    assert got == [("bo5_final", "a", 0), ("bo5_final", "a", 1), ("international", "a", 0),
                   ("international", "a", 1), ("international", "b", 0), ("playoff", "a", 0),
                   ("playoff", "a", 1), ("playoff", "b", 0)]
    kept = P.pressure_datasets(long, ["score"])
    assert {r.player for r in kept.collect()} == {"a"}
    literal = P.pressure_datasets(long, ["score"], require_both=("international",))
    assert sorted(r.context for r in literal.where("player = 'b'").collect()) == ["playoff"]


def test_slopes_lie_between_raw_and_population(spark):
    fit = P.fit_pressure(rows(spark, SPREAD))
    population = fit.population.first()
    assert population.tau2 > 0 and population.n_slopes == 3
    players = {r.player: r for r in fit.players.collect()}
    assert set(players) == {"a", "b", "c"}
    for r in players.values():
        low, high = sorted((r.d, population.mu))
        assert low - 1e-9 <= r.med <= high + 1e-9
        assert r.lo < r.med < r.hi
    assert players["a"].pr_pos > 0.95 and players["b"].pr_pos < 0.05


def test_no_spread_gives_every_player_the_population_effect(spark):
    same = [(p, c, [0.4, 0.5, 0.6]) for p in "ab" for c in (0, 1)]
    fit = P.fit_pressure(rows(spark, same))
    population = fit.population.first()
    assert population.tau2 == 0
    assert all(r.med == population.mu and r.sd == pytest.approx(population.se)
               for r in fit.players.collect())


def test_player_with_one_condition_gets_the_population_effect(spark):
    fit = P.fit_pressure(rows(spark, SPREAD, "bo5_final"))
    population = fit.population.first()
    once = fit.players.where("player = 'once'").first()
    assert once.d is None and once.med == pytest.approx(population.mu)
    assert once.sd == pytest.approx(math.sqrt(population.tau2 + population.se**2))


def test_prior_pulls_the_population_effect_to_zero(spark):
    free = P.fit_pressure(rows(spark, SPREAD), prior_sd=math.inf).population.first()
    tight = P.fit_pressure(rows(spark, SPREAD), prior_sd=0.01).population.first()
    assert abs(tight.mu) < abs(free.mu) or free.mu == 0
    assert tight.se < free.se


def test_opponent_adjustment_removes_an_opponent_effect(spark):
    data = []
    for i, p in enumerate("abcdef"):
        for o, shift in (("weak", 0.3), ("strong", -0.3)):
            for c in (0, 1):
                data += [("playoff", p, o, c, 0.5 + shift + 0.01 * ((i + k) % 3)) for k in range(4)]
    df = spark.createDataFrame(data, SCHEMA)
    plain, adjusted = P.fit_pressure(df), P.fit_pressure(df, opponent="opponent")
    assert adjusted.population.first().s2 < 0.1 * plain.population.first().s2
    gain = P.loo_comparison(plain, adjusted).first()
    assert gain.gain > 0 and gain.n_scored == len(data)


def test_left_out_score_equals_a_loop_over_rows(spark):
    df = rows(spark, SPREAD[:6])
    fit = P.fit_pressure(df)
    n = df.count()
    z = df.withColumn("z", squeeze_logit(F.col("score"), F.lit(n))).collect()
    s2, total = fit.population.first().s2, 0.0
    for r in z:
        others = [q.z for q in z if (q.player, q.pressure) == (r.player, r.pressure)]
        mean = (sum(others) - r.z) / (len(others) - 1)
        total += -0.5 * math.log(2 * math.pi * s2) - (r.z - mean) ** 2 / (2 * s2)
    assert P.loo_score(fit).first().elpd == pytest.approx(total, abs=1e-6)


def test_draws_match_the_posterior_and_repeat(spark):
    fit = P.fit_pressure(rows(spark, SPREAD))
    draws = P.player_draws(fit, P.population_draws(fit))
    summary = {r.player: r for r in P.summarise_slopes(P.total_slopes(draws)).collect()}
    for r in fit.players.collect():
        s = summary[r.player]
        assert s.med == pytest.approx(r.med, abs=0.06)
        assert s.lo == pytest.approx(r.lo, abs=0.15) and s.hi == pytest.approx(r.hi, abs=0.15)
    again = P.summarise_slopes(P.total_slopes(P.player_draws(fit, P.population_draws(fit))))
    assert {r.player: r.med for r in again.collect()} == {p: r.med for p, r in summary.items()}


def test_wide_draws(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, -1.0), (2, 0.0, 3.0, None)],
                               "draw int, b_pressure double, x double, y double")
    wide = df.toDF("draw", "b_pressure", "r_player_id[7,pressure]", "r_player_id[8,pressure]")
    long = P.draws_from_wide(wide, ["draw", "b_pressure"])
    got = P.summarise_slopes(P.total_slopes(long)).orderBy("player").collect()
    assert [(r.player, r.med, r.pr_pos, r["rank"]) for r in got] == [
        ("7", 2.25, 1.0, 2), ("8", -0.5, 0.0, 1)]
    names = spark.createDataFrame([("r_player_id[7,pressure]",)], "c string")
    assert names.select(player_from_parameter("c")).first()[0] == "7"


def test_every_fiftieth_rank_is_labelled(spark):
    df = spark.createDataFrame([(f"p{i:03d}", float(i)) for i in range(120)], "player string, med double")
    got = P.rank_slopes(df).where(F.col("label").isNotNull()).collect()
    assert sorted((r["rank"], r.label) for r in got) == [(50, "p049"), (100, "p099")]


def test_coefficient_rows_start_with_the_population(spark):
    data = rows(spark, SPREAD, "international")
    fit = P.fit_pressure(data)
    table = P.coefficient_rows(fit, P.factor_codes(data), "international").orderBy("rank").collect()
    assert [r["rank"] for r in table] == [0, 1, 2, 3]
    assert table[0].label == "POPULATION AVERAGE" and table[0].player_id is None
    assert [r.label for r in table[1:]] == ["b", "c", "a"]
    assert table[3].summary.startswith(f"{table[3].odds_ratio:.2f} [")


def test_tiers(spark):
    data = [(p, c, float(m), q) for p, ms in {
        "elite": [(1, 0.99)] * 3, "clutch": [(1, 0.9), (0.1, 0.6), (-1, 0.1)],
        "situational": [(1, 0.9), (-0.1, 0.4), (-0.1, 0.4)], "vulnerable": [(-1, 0.1)] * 3,
        "neutral": [(0.1, 0.6)] * 3}.items()
        for c, (m, q) in zip(("playoff", "international", "bo5_final"), ms, strict=True)]
    df = spark.createDataFrame(data, "player string, context string, med double, pr_pos double")
    assert all(r.player == r.tier for r in P.clutch_tiers(df).collect())


def test_score_shares(spark):
    df = rows(spark, [("a", 1, [0.0, 1.0, 1.0, 0.25, 0.75])])
    r = P.score_inflation(df).first()
    assert (r.n, r.zoi, r.interior_mean) == (5, 0.6, 0.5)
    assert r.coi == pytest.approx(2 / 3) and r.phi == pytest.approx(0.25 / 0.0625 - 1)


def test_normal_distribution_function(spark):
    df = spark.createDataFrame([(-1.959964,), (0.0,), (1.0,)], "x double")
    got = [r[0] for r in df.select(normal_cdf(F.col("x"))).collect()]
    assert got == [pytest.approx(v, abs=2e-7) for v in (0.025, 0.5, 0.841344746)]
    text = spark.range(1).select(interval_text(F.lit(1.234), F.lit(0.5), F.lit(2.0))).first()[0]
    assert text == "1.23 [0.50, 2.00]"


def test_a_context_of_ones_own_is_fitted_too(spark):
    rows = [(c, f"p{i % 7}", i % 2, 0.1 + 0.01 * (i * 7 % 83), "t") for c in ("mine", "playoff") for i in range(200)]
    df = spark.createDataFrame(rows, "context string, player string, pressure int, score double, opponent_team string")
    fit = P.fit_pressure(df, opponent="opponent_team")
    assert {r.context for r in fit.players.collect()} == {"mine", "playoff"}
    assert {r.context for r in fit.population.collect()} == {"mine", "playoff"}


def test_beta_fit_is_the_maximum_likelihood(spark):
    rng = random.Random(3)
    shapes = {("a", 0): (2.0, 5.0), ("a", 1): (0.6, 0.4), ("b", 0): (40.0, 8.0)}
    rows = [(c, p, rng.betavariate(*s)) for (c, p), s in shapes.items() for _ in range(800)]
    rows += [("a", 0, 0.0)] * 50 + [("a", 0, 1.0)] * 150 + [("c", 0, 0.5)] * 3 + [("d", 1, 1.0), ("a", 1, None), ("a", 1, 1.5)]
    got = {(r.context, r.pressure): r for r in P.beta_fit(spark.createDataFrame(rows, "context string, pressure int, score double")).collect()}
    for key in shapes:
        r = got[key]
        ys = [y for c, p, y in rows if (c, p) == key and y is not None and 0 < y < 1]
        l1, l0 = sum(map(math.log, ys)) / len(ys), sum(math.log1p(-y) for y in ys) / len(ys)

        def likely(mean, phi):
            a, b = mean * phi, (1 - mean) * phi
            return math.lgamma(phi) - math.lgamma(a) - math.lgamma(b) + (a - 1) * l1 + (b - 1) * l0

        # no neighbour is better, and the slope vanishes
        for name, h in (("mean", 1e-5), ("phi", 1e-5 * r.phi)):
            up, down = ({**{"mean": r["mean"], "phi": r.phi}, name: r[name] + e} for e in (h, -h))
            assert abs(likely(**up) - likely(**down)) / (2 * h) < 1e-5
            assert likely(r["mean"], r.phi) >= max(likely(**up), likely(**down)) - 1e-12
        assert r.moved < 1e-12
    assert (got["a", 0].n, got["a", 0].zoi, got["a", 0].coi) == (1000, 0.2, 0.75)
    assert (got["c", 0].mean, got["d", 1].phi, got["d", 1].coi, got["a", 1].n) == (None, None, 1.0, 800)


def test_digamma_and_trigamma(spark):
    from matchlens.functions.numeric import digamma, trigamma

    xs = [0.01, 0.5, 1.0, 3.3, 50.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", digamma(F.col("x")).alias("d"), trigamma(F.col("x")).alias("t")).collect()
    by = {r.x: r for r in rows}
    euler = 0.5772156649015329
    assert by[1.0].d == pytest.approx(-euler, abs=1e-13) and by[0.5].d == pytest.approx(-euler - 2 * math.log(2), abs=1e-13)
    assert by[1.0].t == pytest.approx(math.pi**2 / 6, abs=1e-13) and by[0.5].t == pytest.approx(math.pi**2 / 2, abs=1e-12)
    for x in xs:
        h = 1e-4 * x
        slope = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        assert by[x].d == pytest.approx(slope, rel=1e-5)


def test_draws_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    draws = spark.range(300).select(F.concat(F.lit("p"), F.col("id") % 3).alias("player"), (F.col("id") / 300).alias("x"))
    betas = draws.withColumn("beta", F.when(F.col("player") != "p2", F.udf(counted, "double")("x"))).repartition(4, "player")
    got = P.summarise_slopes(betas.select("player", F.udf(counted, "double")("x").alias("beta"))).collect()
    assert len(got) == 3 and seen.value == 300  # the filter and the ranking's sample had each drawn again
    assert {r.player for r in P.summarise_slopes(betas).collect()} == {"p0", "p1"}  # only null draws: no row


def test_tasks_that_draw_grow_with_the_players(spark):
    few, many = (P._spread(spark.range(n), ["id"]).rdd.getNumPartitions() for n in (10, 1000))
    assert (few, many) == (4, 1000 // P.SPREAD_ROWS)


def test_contexts_are_laid_out_in_compiled_code(spark):
    schema = "player string, state string, international int, bo5 boolean, final3 boolean, performance_score double"
    long = P.pressure_rows(spark.createDataFrame([("a", "Playoffs", 1, True, None, 0.5), ("b", None, None, None, True, 0.2)], schema))
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Generate inline" in plan
    got = {(r.context, r.player, r.pressure) for r in long.collect()}
    assert got == {("playoff", "a", 1), ("international", "a", 1), ("bo5_final", "a", None)}


def test_moments_of_a_player_need_one_shuffle_and_equal_a_loop(spark):
    data = [("bo5_final", f"p{i % 5}" if i % 11 else None, f"o{i % 3}", (0, 1, None)[i % 7 % 3], None if i % 13 == 0 else i % 17 / 16) for i in range(200)]
    data += [("playoff", "once", "o0", 1, 0.5), ("playoff", "both", "o0", 1, 0.4), ("playoff", "both", "o1", 0, 0.7)]
    long = spark.createDataFrame(data, SCHEMA)
    moments = P.player_moments(long)
    plan = moments._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    n_context = {"bo5_final": sum(c is not None for k, _, _, c, _ in data if k == "bo5_final"), "playoff": 2}
    want = {}
    for context, player, _, pressure, score in data:
        n, total, squares = want.setdefault((context, player, pressure), (0, 0.0, 0.0))
        if score is not None:
            m = n_context[context]
            y = (score * (m - 1) + 0.5) / m
            z = math.log(y / (1 - y))
            n, total, squares = n + 1, total + z, squares + z * z
        want[context, player, pressure] = n, total, squares
    del want["playoff", "once", 1]
    groups = {(r.context, r.player, r.pressure): r for r in P._groups(moments).collect()}
    assert set(groups) == set(want)
    for key, (n, total, squares) in want.items():
        assert groups[key].n == n and groups[key].n_context == n_context[key[0]]
        assert groups[key].mean == pytest.approx(total / n) and groups[key].ss == pytest.approx(squares - total * total / n)


def test_cells_are_a_file_per_bucket_and_give_the_same_moments(spark):
    long = rows(spark, SPREAD)
    cells = P._cells(long, P.BOTH_CONDITIONS, "opponent")
    assert len(cells.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = P._cell_moments(cells)
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    plain = {r.player: r for r in P.player_moments(long).collect()}
    found = {r.player: r for r in again.collect()}
    assert set(found) == set(plain) == {"a", "b", "c"}
    for player, r in found.items():
        for k in (0, 1):
            assert r[f"n{k}"] == plain[player][f"n{k}"] and r[f"p{k}"] == pytest.approx(plain[player][f"p{k}"])
