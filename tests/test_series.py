from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchlens.operators.ordered import ntile_of, ordered_scan, ranked
from matchlens.operators.series import one_row_per_game, series_flags, with_series_flags

SCHEMA = "game_id long, blue_team string, red_team string, winning_team string"


def islands(spec):
    """``spec``: list of (pair, winners); sides swap from game to game."""
    rows, g = [], 100
    for (a, b), winners in spec:
        for i, w in enumerate(winners):
            blue, red = (a, b) if i % 2 == 0 else (b, a)
            rows.append((g, blue, red, w))
            g += 3
    return rows


def expected(rows):
    """The rules of series detection, island by island."""
    out, i = {}, 0
    while i < len(rows):
        j = i
        while j < len(rows) and {rows[j][1], rows[j][2]} == {rows[i][1], rows[i][2]}:
            j += 1
        n = j - i
        bo5 = n >= 4 or (n == 3 and rows[i][3] == rows[i + 1][3])
        for k in range(i, j):
            out[rows[k][0]] = (k - i + 1, n, bo5, n >= 4 and k >= j - 3)
        i = j
    return out


def result(spark, rows, buckets):
    df = series_flags(spark.createDataFrame(rows, SCHEMA), buckets=buckets)
    return {r.game_id: (r.pos, r.series_len, r.bo5, r.final3) for r in df.collect()}


CASES = islands([
    (("A", "B"), "A"),
    (("A", "C"), "AC"),
    (("A", "D"), "AAD"),
    (("B", "D"), "BDB"),
    (("C", "D"), "CCDD"),
    (("A", "E"), "AEAEA"),
    (("B", "E"), "BBBBBB"),
    (("C", "E"), "CCC"),
])


@pytest.mark.parametrize("buckets", [1, 2, 3, 7])
def test_islands_of_all_lengths(spark, buckets):
    assert result(spark, CASES, buckets) == expected(CASES)


@pytest.mark.parametrize("buckets", [1, 5])
def test_one_series_over_all_buckets(spark, buckets):
    rows = islands([(("A", "B"), "AB" * 40), (("A", "C"), "AAC")])
    assert result(spark, rows, buckets) == expected(rows)


def test_last_series_open_and_single_game_and_empty(spark):
    rows = islands([(("A", "B"), "AB"), (("A", "C"), "AAAA")])
    assert result(spark, rows, 3) == expected(rows)
    assert result(spark, rows[:1], 3) == {100: (1, 1, False, False)}
    assert result(spark, [], 3) == {}


def test_random_series_in_many_buckets(spark):
    rng = random.Random(7)
    spec = []
    for _ in range(60):
        a, b = rng.sample("ABCD", 2)
        spec.append(((a, b), [rng.choice((a, b)) for _ in range(rng.randint(1, 6))]))
    rows = islands(spec)
    assert result(spark, rows, 8) == expected(rows)


def test_partitions_are_independent(spark):
    rows = [("x", *r) for r in CASES] + [("y", *r) for r in CASES]
    df = spark.createDataFrame(rows, "league string, " + SCHEMA)
    flags = series_flags(df, ["league"], buckets=4)
    for league in ("x", "y"):
        got = {
            r.game_id: (r.pos, r.series_len, r.bo5, r.final3)
            for r in flags.where(F.col("league") == league).collect()
        }
        assert got == expected(CASES)


def test_flags_reach_every_player_row(spark):
    players = spark.createDataFrame(
        [(r[0], f"p{i}", *r[1:]) for r in CASES for i in range(10)],
        "game_id long, player string, blue_team string, red_team string, winning_team string",
    )
    flags = series_flags(one_row_per_game(players))
    joined = with_series_flags(players, flags, ["player"])
    want = expected(CASES)
    got = joined.collect()
    assert len(got) == 10 * len(CASES)
    assert all((r.bo5, r.final3) == want[r.game_id][2:] for r in got)


@pytest.mark.parametrize("buckets", [1, 2, 9])
def test_ordered_scan_equals_a_plain_loop(spark, buckets):
    rng = random.Random(3)
    rows = [(g, k, rng.randint(0, 9)) for g in ("hot", "cold") for k in range(50 if g == "hot" else 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v long")
    out = ordered_scan(
        df, ["k"], ["g"], sums={"before": F.col("v")}, lags={"prev": "v"}, totals=True,
        buckets=buckets,
    ).collect()
    for r in out:
        earlier = sorted((k, v) for g, k, v in rows if g == r.g and k < r.k)
        assert r.before == sum(v for _, v in earlier)
        assert r.prev == (earlier[-1][1] if earlier else None)
        assert r.before_total == sum(v for g, _, v in rows if g == r.g)


def test_ranked_with_ties_and_ntile(spark):
    rows = [(0.0, f"p{i:02d}") for i in range(23)]
    df = ranked(spark.createDataFrame(rows, "med double, p string"), ["med", "p"], count="n",
                buckets=4)
    got = df.withColumn("t", ntile_of("rank", "n", 10)).orderBy("rank").collect()
    assert [r.p for r in got] == [p for _, p in rows]
    assert [r.t for r in got] == [1 + i // 3 if i < 9 else 4 + (i - 9) // 2 for i in range(23)]
