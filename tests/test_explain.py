from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from matchlens.functions.numeric import sigmoid
from matchlens.operators import explain as X
from matchlens.schema import FEATURES

NAMES = ["a", "b", "c"]


def frame(spark, n=12):
    rows = [("Top", f"k{i}", math.sin(i), math.cos(3 * i), (i % 4) - 1.5) for i in range(n)]
    return spark.createDataFrame(rows, "role string, key string, a double, b double, c double")


def logistic(df):
    return df.withColumn("score", sigmoid(F.col("a") - 2 * F.col("b") + F.col("a") * F.col("c")))


@pytest.mark.parametrize("design", [X.exact_design(3), X.permutation_design(3, 2)])
def test_values_add_up_to_score_minus_mean_background_score(spark, design):
    sample = X.explained_sample(frame(spark), ["key"], ["role"], n=10)
    values = X.shapley_values(sample, sample, logistic, design, ["key"], ["role"], NAMES, 5)
    base = logistic(sample.where("sample_no <= 5")).agg(F.avg("score")).first()[0]
    scores = {r.key: r.score for r in logistic(sample).collect()}
    got = values.collect()
    assert len(got) == 10
    for r in got:
        assert r.shap_a + r.shap_b + r.shap_c == pytest.approx(scores[r.key] - base, abs=1e-12)


def test_all_permutations_give_the_exact_values(spark):
    sample = X.explained_sample(frame(spark), ["key"], ["role"], n=6)
    exact = X.shapley_values(sample, sample, logistic, X.exact_design(3), ["key"], ["role"], NAMES, 6)
    many = X.shapley_values(
        sample, sample, logistic, X.permutation_design(3, 400), ["key"], ["role"], NAMES, 6)
    near = {r.key: r.shap_a for r in many.collect()}
    assert all(r.shap_a == pytest.approx(near[r.key], abs=0.02) for r in exact.collect())


def test_linear_scorer_gets_coefficient_times_distance(spark):
    sample = X.explained_sample(frame(spark), ["key"], ["role"], n=8)

    def score(df):
        return df.withColumn("score", 3 * F.col("a") - F.col("b") + 0.5 * F.col("c"))

    means = sample.agg(*[F.avg(n).alias(n) for n in NAMES]).first()
    values = X.shapley_values(sample, sample, score, X.exact_design(3), ["key"], ["role"], NAMES, 8)
    joined = values.join(sample, "key").collect()
    for r in joined:
        assert r.shap_a == pytest.approx(3 * (r.a - means.a), abs=1e-12)
        assert r.shap_b == pytest.approx(-(r.b - means.b), abs=1e-12)


def solved(design, value):
    return [sum(w[j] * value[m] for m, w in design) for j in range(len(design[0][1]))]


def test_kernel_values_approach_the_exact_ones():
    rng = random.Random(4)
    n = 7
    a, b = [rng.gauss(0, 1) for _ in range(n)], {(i, j): rng.gauss(0, 0.7) for i in range(n) for j in range(i)}
    value = [1 / (1 + math.exp(-sum(a[i] for i in range(n) if m >> i & 1) - sum(w for (i, j), w in b.items() if m >> i & 1 and m >> j & 1))) for m in range(2**n)]
    exact = solved(X.exact_design(n), value)
    off, within = {}, 0
    for pairs in (24, 96, 384):
        designs = X.kernel_designs(n, pairs, batches=20, seed=pairs)
        each = [solved(d, value) for d in designs]
        assert all(sum(phi) == pytest.approx(value[-1] - value[0], abs=1e-10) for phi in each)
        mean = [statistics.mean(phi[j] for phi in each) for j in range(n)]
        error = [statistics.stdev(phi[j] for phi in each) / math.sqrt(20) for j in range(n)]
        within += sum(abs(m - e) <= 3 * s + 1e-12 for m, e, s in zip(mean, exact, error, strict=True))
        off[pairs] = math.sqrt(statistics.mean((phi[j] - exact[j]) ** 2 for phi in each for j in range(n)))
    assert within >= 19 and off[24] > 1.6 * off[96] > 1.6 * 1.6 * off[384]
    few = X.kernel_designs(9, 2, batches=3)
    assert all(len(d) >= 9 for d in few)
    for d in few:  # a linear score is exact however few were drawn
        assert solved(d, [sum((j + 1.0) * (m >> j & 1) for j in range(9)) for m in range(512)]) == pytest.approx([j + 1.0 for j in range(9)])


def test_kernel_job_gives_the_solved_designs_and_their_spread(spark):
    sample = X.explained_sample(frame(spark), ["key"], ["role"], n=8)
    designs = X.kernel_designs(3, 6, batches=4)
    got = {r.key: r for r in X.kernel_shapley(sample, sample, logistic, designs, ["key"], ["role"], NAMES, 8).collect()}
    parts = [{r.key: r for r in X.shapley_values(sample, sample, logistic, d, ["key"], ["role"], NAMES, 8).collect()} for d in designs]
    assert len(got) == 8
    for key, r in got.items():
        for n in NAMES:
            each = [p[key][f"shap_{n}"] for p in parts]
            assert r[f"shap_{n}"] == pytest.approx(statistics.mean(each), abs=1e-12)
            assert r[f"se_{n}"] == pytest.approx(statistics.stdev(each) / 2, abs=1e-12)
    one = X.kernel_shapley(sample, sample, lambda df: df.withColumn("score", 3 * F.col("a") - F.col("b")), designs[:1], ["key"], ["role"], NAMES, 8)
    means = sample.agg(*[F.avg(n).alias(n) for n in NAMES]).first()
    for r in one.join(sample, "key").collect():
        assert (r.shap_a, r.shap_c, r.se_a) == (pytest.approx(3 * (r.a - means.a), abs=1e-10), pytest.approx(0.0, abs=1e-10), None)


def test_too_many_cells_are_refused_where_a_limit_is_given(spark):
    sample = X.explained_sample(frame(spark), ["key"], ["role"])
    design = X.exact_design(3)
    X.shapley_values(sample, sample, logistic, design, ["key"], ["role"], NAMES)
    with pytest.raises(ValueError, match="scored cells"):
        X.shapley_values(sample, sample, logistic, design, ["key"], ["role"], NAMES, max_cells=10)


def test_scored_rows_lie_in_as_many_partitions_as_configured(spark):
    sample = X.explained_sample(frame(spark, 400), ["key"], ["role"], n=400)
    seen = []

    def score(df):
        seen.append(df.select(F.spark_partition_id().alias("p")))
        return logistic(df)

    X.shapley_values(sample, sample, score, X.exact_design(3), ["key"], ["role"], NAMES)
    assert seen[0].distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_designs_are_weights_that_cancel():
    for design in (X.exact_design(4), X.permutation_design(4, 3)):
        for j in range(4):
            assert sum(w[j] for _, w in design) == pytest.approx(0.0)
            assert sum(w[j] for m, w in design if m >> j & 1) == pytest.approx(1.0)


def importance(spark):
    rows = [(role, "logistic", f, float(10 * i + j))
            for i, role in enumerate(("Top", "Mid")) for j, f in enumerate(FEATURES)]
    return spark.createDataFrame(rows, "role string, model string, feature string, importance double")


def test_missing_role_counts_as_zero(spark):
    rows = X.importance_comparison(importance(spark)).collect()
    assert len(rows) == len(FEATURES)
    assert all(r.ADC == 0.0 and r.Mid == r.Top + 10 for r in rows)


def test_common_order_and_leading_features(spark):
    order = {r.feature: r.position for r in X.common_feature_order(importance(spark)).collect()}
    assert order[FEATURES[-1]] == 1 and len(order) == 10 and FEATURES[0] not in order
    top = X.top_features(importance(spark), ["role", "model"]).collect()
    assert len(top) == 10 and {r.feature for r in top} == set(FEATURES[-5:])
    shares = X.with_share(importance(spark), ["role", "model"]).groupBy("role").agg(F.sum("share"))
    assert all(r[1] == pytest.approx(1.0) for r in shares.collect())


def test_linear_importance_is_the_mean_of_absolute_values(spark):
    rows = [("Top" if i % 2 else "Mid", f"k{i}", math.sin(i), math.cos(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "role string, key string, z_a double, z_b double")
    df = df.withColumns({"a": F.col("z_a"), "b": F.col("z_b")})
    table = spark.createDataFrame(
        [(r, m, 0.1, c, -2 * c) for r in ("Top", "Mid") for m, c in (("x", 1.5), ("y", -0.5))],
        "role string, model string, intercept double, b_a double, b_b double")
    wide = X.linear_shap(df, table, ["role", "model"], ["key"], ["a", "b"])
    want = {(r.role, r.model, r.feature): r.importance for r in X.mean_abs_shap(wide, ["role", "model"], ["a", "b"]).collect()}
    got = {(r.role, r.model, r.feature): r.importance for r in X.linear_importance(df, table, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
