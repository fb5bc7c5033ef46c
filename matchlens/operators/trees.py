"""Exact Shapley values of forests and boosted trees from the leaf paths of saved models.

A leaf is a box: an interval for every feature on its path. For an explained row and a background row
a leaf counts in a coalition when the features in the coalition put the row inside and the others put
the background row inside. With ``a`` path features that only the row meets and ``b`` that only the
background row meets, the leaf's value is shared by factorials of a and b; no coalition is visited.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.schema import ROLES
from matchlens.sources.storage import matching_paths, pinned, sized

LEAF = ["role", "model", "tree", "leaf"]
#: Leaves of all models up to this number go to every task; they are counted.
MOST_LEAVES = 1_000_000
INF = float("inf")


def saved_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Node rows of all forests and boosted trees saved below `base` (``<role>/<model>/stages/...``).

    ``role, model, tree, node, left, right, feature, threshold, value``: the value is a leaf's share
    of the score, on the probability scale for forests and on the log-odds scale for boosted trees.
    Splits by category are refused.
    """
    found = matching_paths(spark, f"{base.rstrip('/')}/*/*/stages/*_*Classifier_*/treesMetadata")
    if not found:
        raise FileNotFoundError(f"no tree models below {base}")
    place = r"/([^/]+)/([^/]+)/stages/[0-9]+_([A-Za-z]+)_[^/]*/(?:data|treesMetadata)/[^/]*$"
    known = {r.lower(): r for r in ROLES}

    def located(kind: str) -> DataFrame:
        path = F.col("_metadata.file_path")
        read = spark.read.parquet(*[f.rsplit("/", 1)[0] + f"/{kind}" for f in found])
        role = F.regexp_extract(path, place, 1)
        named = F.coalesce(*[F.when(role == k, v) for k, v in known.items()], role)
        return read.select("*", named.alias("role"), F.regexp_extract(path, place, 2).alias("model"), F.regexp_extract(path, place, 3).alias("kind"))

    weights = located("treesMetadata").select("role", "model", F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    counts = weights.groupBy("role", "model").agg(F.count(F.lit(1)).alias("trees"))
    n, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    votes = F.aggregate(stats, F.lit(0.0), lambda x, y: x + y)
    forest = F.try_divide(stats[1], votes) / F.col("trees")
    boosted = 2 * n["prediction"] * F.col("weight")
    threshold = F.when(n["split"]["numCategories"] == -1, n["split"]["leftCategoriesOrThreshold"][0])
    split = n["leftChild"] >= 0
    return (
        located("data").withColumnRenamed("treeID", "tree").join(weights, ["role", "model", "tree"]).join(counts, ["role", "model"])
        .select(
            "role", "model", "tree", n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
            n["split"]["featureIndex"].alias("feature"),
            F.when(split, F.coalesce(threshold, F.raise_error(F.lit("a split by category")).cast("double"))).alias("threshold"),
            F.when(~split, F.when(F.col("kind").startswith("GBT"), boosted).otherwise(forest)).alias("value"),
        )
    )


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """``role, model, tree, leaf, value, path``: for each feature on the way to the leaf the interval (lo, hi].

    The walk goes down from the roots, one join per level of the deepest tree.
    """
    nodes = pinned(nodes, "nodes")
    up, down = F.lit(INF), F.lit(-INF)
    step = lambda lo, hi: F.struct(F.col("feature").alias("feature"), lo.alias("lo"), hi.alias("hi"))
    at = nodes.where("node = 0").withColumn("path", F.from_json(F.lit("[]"), "array<struct<feature:int,lo:double,hi:double>>"))
    leaves = at.where("left < 0")
    at = at.where("left >= 0")
    while at.limit(1).count():
        children = F.array(
            F.struct(F.col("left").alias("child"), step(down, F.col("threshold")).alias("step")),
            F.struct(F.col("right").alias("child"), step(F.col("threshold"), up).alias("step")),
        )
        below = at.select("role", "model", "tree", "path", F.inline(children)).select(
            "role", "model", "tree", F.col("child").alias("node"), F.array_append("path", F.col("step")).alias("path")
        )
        at = pinned(below.join(nodes, ["role", "model", "tree", "node"]), "level")
        leaves = leaves.unionByName(at.where("left < 0"))
        at = at.where("left >= 0")
    features = F.array_distinct(F.transform("path", lambda p: p["feature"]))

    def interval(f: Column) -> Column:
        own = F.filter("path", lambda p: p["feature"] == f)
        return F.struct(
            f.alias("feature"), F.array_max(F.transform(own, lambda p: p["lo"])).alias("lo"), F.array_min(F.transform(own, lambda p: p["hi"])).alias("hi")
        )

    return leaves.select("role", "model", "tree", F.col("node").alias("leaf"), "value", F.transform(features, interval).alias("path"))


def _met(x: Column, path: Column) -> Column:
    """Bit mask of the path's features whose interval holds the row's value."""
    one = F.lit(1).cast("long")
    bit = lambda f: F.call_function("shiftleft", one, f)
    value = lambda p: F.get(x, p["feature"])
    inside = lambda p: ((value(p) > p["lo"]) | (p["lo"] == -INF)) & ((value(p) <= p["hi"]) | (p["hi"] == INF))
    return F.aggregate(path, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.when(inside(p), bit(p["feature"])).otherwise(F.lit(0).cast("long"))))


def _share(n: int, a: Column, b: Column) -> Column:
    """(a - 1)! b! / (a + b)! for a of at least 1."""
    table = [[math.factorial(i - 1) * math.factorial(j) / math.factorial(i + j) if i else 0.0 for j in range(n + 1)] for i in range(n + 1)]
    return F.get(F.get(F.array(*[F.array(*map(F.lit, row)) for row in table]), a), b)


def tree_shapley(
    leaves: DataFrame, rows: DataFrame, background: DataFrame, key: list[str], features: list[str], by: str = "role"
) -> DataFrame:
    """``role, model, <key>, shap_<feature>..., base, score`` for every row and every model of its role.

    ``base`` is the mean score of the background rows of the role; the values add up to ``score - base``.
    `features` are the models' inputs in the order of the saved feature numbers (62 at most). Every row
    meets every leaf of its role's models. Background rows are reduced to the share of them that meets
    the same path features of a leaf, so their number costs nothing per explained row. Nulls
    count as NaN, which exceeds all numbers, as in the models. Rows of a role without a model or without background are left out.
    """
    if len(features) > 62:
        raise ValueError("at most 62 features")
    leaves = sized(leaves.withColumn("whole", F.aggregate("path", F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), p["feature"])))), MOST_LEAVES)
    x = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features])
    n_rows = background.groupBy(by).agg(F.count(F.lit(1)).alias("n_background"))
    met = background.select(by, x.alias("x")).join(leaves, by).select(*LEAF, _met(F.col("x"), F.col("path")).alias("theirs"))
    shares = met.groupBy(*LEAF, "theirs").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n_rows) if by == "role" else n_rows, by)
    shares = sized(shares.select(*LEAF, "theirs", (F.col("n") / F.col("n_background")).alias("share")), MOST_LEAVES)
    pairs = (
        rows.select(by, *key, x.alias("x")).join(leaves, by)
        .select(*LEAF, *key, "value", "whole", _met(F.col("x"), F.col("path")).alias("own"))
        .join(shares, LEAF)
        .where(F.col("own").bitwiseOR(F.col("theirs")) == F.col("whole"))
        .withColumns({"mine": F.col("own").bitwiseAND(F.bitwise_not("theirs")), "other": F.col("theirs").bitwiseAND(F.bitwise_not("own"))})
        .withColumns({"a": F.bit_count("mine"), "b": F.bit_count("other"), "v": F.col("value") * F.col("share")})
        .withColumns({"plus": F.col("v") * _share(len(features), F.col("a"), F.col("b")), "minus": F.col("v") * _share(len(features), F.col("b"), F.col("a"))})
    )
    part = lambda j: F.when(F.col("mine").bitwiseAND(1 << j) != 0, F.col("plus")).when(
        F.col("other").bitwiseAND(1 << j) != 0, -F.col("minus")).otherwise(0.0)
    return pairs.groupBy("role", "model", *key).agg(
        *[F.sum(part(j)).alias(f"shap_{f}") for j, f in enumerate(features)],
        F.sum(F.when(F.col("theirs") == F.col("whole"), F.col("v")).otherwise(0.0)).alias("base"),
        F.sum(F.when(F.col("own") == F.col("whole"), F.col("v")).otherwise(0.0)).alias("score"),
    )
