"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import lookup, stored


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of the edges: equal when a round changed nothing."""
    hashed = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `pairs`; the root is the smallest node that it can reach.

    Each round ties the larger neighbours of every node, then the smaller ones, to the smallest
    neighbour; the rounds needed grow with the logarithm of a component, not with its diameter.
    Only aggregates and spread lookups touch the edges, so a node with most of the edges is dealt
    over many tasks, and every round's edges are a stored table. Self pairs and nulls are ignored.
    """
    edges = stored(
        pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # b is the larger end
        large = lookup(larger, least, "a", ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, least, "a", ["b"])
        edges = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "edges",
        )
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
