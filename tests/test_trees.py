from __future__ import annotations

import itertools
import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from matchlens.operators import trees
from matchlens.sources.model_store import model_path
from matchlens.sources.storage import scratch_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    u = [F.rand(i) for i in range(4)]
    df = spark.range(240).select(F.col("id").alias("key"), F.lit("Top").alias("role"), *[F.round(x, 2).alias(f) for x, f in zip(u, FEATURES, strict=True)])
    return spark.createDataFrame(df.withColumn("win", ((F.col("a") + F.col("b") * F.col("c") > 0.7) | (F.col("d") > 0.9)).cast("int")).collect())


def design(score, row, background):
    """Shapley's definition over all coalitions."""
    n, values = len(FEATURES), []
    mean = {
        s: sum(score({f: (row if f in s else z)[f] for f in FEATURES}) for z in background) / len(background)
        for k in range(n + 1) for s in itertools.combinations(FEATURES, k)
    }
    for f in FEATURES:
        rest = [g for g in FEATURES if g != f]
        values.append(sum(
            math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
            * (mean[tuple(g for g in FEATURES if g in s or g == f)] - mean[s])
            for k in range(n) for s in itertools.combinations(rest, k)
        ))
    return values, mean[()], mean[tuple(FEATURES)]


def test_saved_models_equal_all_coalitions(spark, rows):
    base = scratch_path(spark, "models")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fitted = {}
    for name, classifier in {
        "random_forest": RandomForestClassifier(labelCol="win", numTrees=3, maxDepth=3, seed=5),
        "xgboost": GBTClassifier(labelCol="win", maxIter=3, maxDepth=2, seed=5),
    }.items():
        fitted[name] = Pipeline(stages=[assembler, classifier]).fit(rows)
        fitted[name].write().overwrite().save(model_path(base, "Top", name))
    leaves = trees.leaf_paths(trees.saved_nodes(spark, base))
    explained, background = rows.where("key < 6"), rows.where("key % 20 = 0")
    got = {(r.model, r.key): r for r in trees.tree_shapley(leaves, explained, background, ["key"], FEATURES).collect()}
    assert len(got) == 12

    boxes = leaves.collect()
    def scorer(name):
        own = [b for b in boxes if b.model == name]
        return lambda x: sum(b.value for b in own if all(p.lo < x[FEATURES[p.feature]] <= p.hi for p in b.path))

    back = [r.asDict() for r in background.collect()]
    for name, model in fitted.items():
        probability = {r.key: r.p for r in model.transform(explained).select("key", vector_to_array("probability")[1].alias("p")).collect()}
        for row in explained.collect():
            r = got[name, row.key]
            values, low, high = design(scorer(name), row.asDict(), back)
            assert [r[f"shap_{f}"] for f in FEATURES] == pytest.approx(values, abs=1e-12)
            assert (r.base, r.score) == (pytest.approx(low), pytest.approx(high))
            own = r.score if name == "random_forest" else 1 / (1 + math.exp(-r.score))
            assert own == pytest.approx(probability[row.key], abs=1e-12)  # the leaves are the model


def test_odd_inputs(spark):
    nodes = spark.createDataFrame(
        [("Top", "m", 0, 0, 1, 2, 0, 0.5, None), ("Top", "m", 0, 1, -1, -1, -1, None, 0.2), ("Top", "m", 0, 2, -1, -1, -1, None, 0.8),
         ("Top", "m", 1, 0, -1, -1, -1, None, 0.1)],  # a tree that is one leaf
        "role string, model string, tree int, node int, left int, right int, feature int, threshold double, value double",
    )
    leaves = trees.leaf_paths(nodes)
    rows = spark.createDataFrame([("Top", 1, 0.5), ("Top", 2, None), ("Top", 3, float("nan")), ("Mid", 4, 0.1)], "role string, key int, a double")
    got = {r.key: r for r in trees.tree_shapley(leaves, rows, rows.where("key = 1"), ["key"], ["a"]).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].shap_a == 0 and got[1].score == pytest.approx(0.3)
    assert got[2].shap_a == got[3].shap_a == pytest.approx(0.6) and got[2].score == pytest.approx(0.9)
    assert trees.tree_shapley(leaves, rows.limit(0), rows, ["key"], ["a"]).count() == 0
    with pytest.raises(FileNotFoundError):
        trees.saved_nodes(spark, scratch_path(spark, "none"))
