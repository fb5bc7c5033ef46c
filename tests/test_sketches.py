from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from matchlens.operators import sketches as SK


def make(spark):
    rng = random.Random(8)
    rows = [(f"b{i % 7}", "big" if rng.random() < 0.9 else "small", rng.randrange(30_000), rng.gauss(0.3, 1.0)) for i in range(80_000)]
    rows += [("b9", "none", None, None), ("b9", "none", None, float("nan")), (None, "small", 1, 5.0)]
    return rows, spark.createDataFrame(rows, "batch string, grp string, item int, x double").repartition(6)


def test_merged_batches_stay_within_the_stated_error(spark, tmp_path):
    rows, df = make(spark)
    stored = str(tmp_path / "s")
    for batches in (["b0", "b1", "b2"], ["b3", "b4", "b5", "b6", "b9"], [None]):  # batch by batch, nothing read twice
        part = df.where(F.col("batch").isNull() if batches == [None] else F.col("batch").isin(batches))
        SK.sketch(part, ["batch", "grp"], {"items": F.col("item")}, {"x": F.col("x")}).write.mode("append").parquet(stored)
    merged = SK.merge(spark.read.parquet(stored), ["grp"])
    points = (0.025, 0.5, 0.975)
    got = {
        r.grp: r for r in merged.select(
            "grp", "n", SK.distinct_count("items").alias("items"), F.array(*[SK.quantile("x", p) for p in points]).alias("q"), SK.share_above("x", 0).alias("above")
        ).collect()
    }
    for grp in ("big", "small"):
        xs = np.sort([x for _, g, _, x in rows if g == grp])
        items = len({i for _, g, i, _ in rows if g == grp})
        assert got[grp].n == len(xs)
        assert abs(got[grp]["items"] / items - 1) <= 4 * SK.distinct_error()
        for p, q in zip(points, got[grp].q, strict=True):
            assert abs(np.searchsorted(xs, q) / len(xs) - p) <= 1.5 * SK.rank_error()
        assert abs(got[grp].above - np.mean(xs > 0)) <= 1.5 * SK.rank_error()
    none = got["none"]
    assert (none.n, none["items"], none.q, none.above) == (2, 0, [None] * 3, None)
    assert SK.merge(spark.read.parquet(stored).limit(0), ["grp"]).count() == 0


def test_sketched_slopes_follow_the_exact_ones(spark):
    rng = random.Random(2)
    draws = [("c", f"p{p}", d, rng.gauss(p - 2, 0.5)) for p in range(5) for d in range(4000)]
    df = spark.createDataFrame(draws, "context string, player string, draw int, beta double")
    parts = SK.sketch(df.withColumn("chain", F.col("draw") % 4), ["chain", "context", "player"], {}, {"beta": F.col("beta")})
    got = {r.player: r for r in SK.summarise_sketched_slopes(parts, ["context"]).collect()}
    for p in range(5):
        xs = np.sort([x for _, n, _, x in draws if n == f"p{p}"])
        r = got[f"p{p}"]
        for at, q in ((0.025, r.lo), (0.5, r.med), (0.975, r.hi)):
            assert abs(np.searchsorted(xs, q) / len(xs) - at) <= 1.5 * SK.rank_error()
        assert r["rank"] == p + 1 and abs(r.pr_pos - np.mean(xs > 0)) <= 1.5 * SK.rank_error()


def test_registered_sketches_against_the_exact_queries(spark):
    from matchlens.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    exact, near = QUERIES["dataset_summary"](spark, sf).first(), QUERIES["dataset_summary_sketch"](spark, sf).first()
    assert near.player_rows == exact.player_rows
    for name in ("games", "bo5_games", "final3_games"):
        assert abs(near[name] - exact[name]) <= 4 * near.distinct_error * exact[name]
    exact = {(r.context, r.player): r for r in QUERIES["slope_summary"](spark, sf).collect()}
    near = {(r.context, r.player): r for r in QUERIES["slope_summary_sketch"](spark, sf).collect()}
    assert near.keys() == exact.keys() and len(near) > 5
    for key, r in near.items():
        assert exact[key].lo < r.med < exact[key].hi and abs(r.pr_pos - exact[key].pr_pos) <= 2 * SK.rank_error()
