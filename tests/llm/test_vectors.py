from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import vectors
from matchlens.llm.queries import op11_sign_hash_dedup

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, cosine=0.95):
    """Links and components of (id, vector) rows, pair by pair."""
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = []
    for (_, v), g in zip(rows, good, strict=True):
        x = np.array(v, float) / max(map(abs, v)) if g else None
        unit.append(x / np.linalg.norm(x) if g else None)
    links = [
        [j for j in range(len(rows)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
        for i in range(len(rows))
    ]
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((own, len(links[i]), least, own is not None and own == least))
    return sorted(out, key=str)


def found(df, **settings):
    return sorted((tuple(r) for r in vectors.near_duplicates(df, **settings).collect()), key=str)


def near(rng, x, angle):
    side = rng.standard_normal(len(x))
    side -= x * (x @ side) / (x @ x)
    return math.cos(angle) * x / np.linalg.norm(x) + math.sin(angle) * side / np.linalg.norm(side)


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows = [rng.standard_normal(24) for _ in range(150)]
    hot = rng.standard_normal(24)
    rows += [near(rng, hot, a) for a in rng.uniform(0, 0.35, 120)]  # a group of more than one block
    chain = [rng.standard_normal(24)]
    for _ in range(15):
        chain.append(near(rng, chain[-1], 0.3))
    rows += chain + [rows[0]] * 5 + [rows[1] * 7.5, rows[2] * 1e-200, rows[3] * 1e200]
    data = [(i * 7 % 997, [float(c) for c in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert found(df, block=block, miss=1e-6) == brute(data)


def test_odd_vectors(spark):
    data = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]),
        (8, [1.0, -0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None), (7, [1.0, 0.0]), (7, [-1.0, 0.0]),
        (10, [5e-324, 0.0]), (11, [1e308, 1e308]), (12, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(data, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "class", "v", "n_links", "bucket", "dims")])
    assert found(df, miss=1e-6) == brute(data)
    assert found(df.limit(0)) == []


def test_settings():
    for bits in (4, 10, 20):
        n = vectors.table_count(bits, 0.95, 0.001)
        together = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - together) ** n <= 0.001 < (1 - together) ** (n - 1)
    assert [vectors.key_bits(n) for n in (0, 1, 10**4, 10**6, 10**9)] == [4, 4, 4, 10, 20]


def test_query(spark):
    out = op11_sign_hash_dedup(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"} and out.count() == 500
