from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import whitening
from matchlens.llm.queries import op12_jacobi_davidson

SCHEMA = "vec_id long, embedding array<double>"


def brute(data, k=16):
    """{id: (n, deviation, centred vector)} and (V's eigenvalues, trace, mean, distinct integer vectors) by dense algebra."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in data if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    centred = {i: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) for i, x in kept}
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    return n, dev, centred, e[::-1][:k], q[:, ::-1][:, :k], np.trace(v), y


def check(rows, data, k=16):
    n, dev, centred, e, q, trace, fit = brute(data, k)
    by = {}
    for r in rows:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, len(by) + 1)) and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error <= 1e-9
    for c, own in by.items():
        want = {i: centred[i] @ q[:, c - 1] / math.sqrt(e[c - 1]) for i in centred}
        sign = np.sign(sum(own[i].whitened * want[i] for i in want))
        assert set(own) == set(want)
        for i, r in own.items():
            assert (r.n, r.deviation) == (n, dev[i]) and math.isclose(r.explained, e[c - 1] / trace, rel_tol=1e-11)
            assert abs(r.whitened - sign * want[i]) < 1e-8


@pytest.mark.parametrize("dims", [3, 20, 60])
def test_equals_dense_algebra(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((300, dims)) * np.linspace(1, 0.3, dims)
    data = [(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(300 + i, [float(c) for c in x[0]]) for i in range(40)]
    out = whitening.whitened(spark.createDataFrame(data, SCHEMA).repartition(20))  # more arrays than one task adds
    check(out.collect(), data)


def test_dropped_clashing_empty(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(c) for c in r]) for i, r in enumerate(rng.standard_normal((50, 4)))]
    odd = [(100, None), (101, []), (102, [None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [-float("inf")] * 4)]
    df = spark.createDataFrame(data + odd, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "x", "v", "dims", "n")])
    check(whitening.whitened(df).collect(), data + odd)
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id >= 100")).count() == 0
    assert whitening.whitened(df.where("vec_id = 3")).count() == 0  # no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)] + [(None, [0.0, 0.0, 1.0])] * 3, SCHEMA)
    got = whitening.whitened(flat).collect()
    assert {r.component for r in got} == {1} and len(got) == 12 and {r.n for r in got} == {9}


def test_lengths_have_their_own_fit_and_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    three = [(i, [float(c) for c in r]) for i, r in enumerate(rng.standard_normal((40, 3)))]
    two = [(100 + i, [float(c) for c in r]) for i, r in enumerate(rng.standard_normal((30, 2)) * 1e5)]
    out = whitening.whitened(spark.createDataFrame(three + two, SCHEMA)).collect()
    check([r for r in out if r.vec_id < 100], three)
    check([r for r in out if r.vec_id >= 100], two)
    huge = whitening.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.5]), (3, [0.0, 1.0])], SCHEMA)).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None), (3, 9216)}


def test_solver_with_close_values_and_restarts():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    e = np.concatenate([[5, 5, 5 - 1e-9, 4], np.linspace(3, 0.1, 196)])
    v = (q * e) @ q.T
    values, vectors, told = whitening.jacobi_davidson(lambda w: v @ w, 200, 16)
    assert np.allclose(values, e[:16], rtol=1e-13) and np.abs(v @ vectors - vectors * values).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12 and told["rounds"] > 4


def test_query(spark):
    out = op12_jacobi_davidson(spark, "/root/testdata/sf0.001")
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(out.collect(), data)
