"""Reproducible splits and samples by hash, without sorting whole strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlens.sources.storage import sized

_PREFIX = 4  # hex digits of the hash that number a slot: 65,536 slots per stratum


def key_hash(key: list[str], seed: int) -> Column:
    """md5 of the row key and the seed: the same on every engine and on every retry."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def hash_cutpoints(
    df: DataFrame, strata: list[str], key: list[str], fractions: list[float], seed: int = 42
) -> DataFrame:
    """Per stratum the hash at rank ``round(fraction * n)``, one column ``cut_<i>`` per fraction.

    Counting by hash slot is a map-side aggregate; only the one slot that holds the wanted rank
    (about n / 65,536 rows) is sorted. ``cut_<i>`` is NULL when the rank is zero.
    """
    hashed = df.select(*strata, key_hash(key, seed).alias("__h")).withColumn(
        "__slot", F.substring("__h", 1, _PREFIX)
    )
    slots = hashed.groupBy(*strata, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    up = W.partitionBy(*strata).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    spread = (
        slots.withColumn("__before", F.coalesce(F.sum("__n").over(up), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(W.partitionBy(*strata)))
        .withColumn(
            "__goal",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("i"),
                            F.round(F.col("__total") * f).cast("long").alias("rank"),
                        )
                        for i, f in enumerate(fractions)
                    ]
                )
            ),
        )
    )
    wanted = spread.where(
        (F.col("__goal.rank") > F.col("__before"))
        & (F.col("__goal.rank") <= F.col("__before") + F.col("__n"))
    ).select(
        *strata,
        "__slot",
        F.col("__goal.i").alias("__i"),
        (F.col("__goal.rank") - F.col("__before")).alias("__r"),
    )
    # One row per stratum and fraction, so the join reads the rows once without moving them.
    wanted = sized(wanted)
    inside = W.partitionBy(*strata, "__i").orderBy("__h")
    found = (
        hashed.join(wanted, [*strata, "__slot"])
        .withColumn("__rn", F.row_number().over(inside))
        .where(F.col("__rn") == F.col("__r"))
    )
    return sized(
        found.groupBy(*strata).agg(
            *[
                F.max(F.when(F.col("__i") == i, F.col("__h"))).alias(f"cut_{i}")
                for i in range(len(fractions))
            ]
        )
    )


def hash_parts(
    df: DataFrame,
    strata: list[str],
    key: list[str],
    fractions: list[float],
    seed: int = 42,
    group: str | None = None,
    name: str = "part",
) -> DataFrame:
    """Number the rows of every stratum by rising hash share: part 0 up to the first fraction, and
    so on. Part sizes are exact in every stratum; rows with the same key stay together.

    With ``group`` (for example the game) whole groups share a part, and the sizes are exact over
    groups instead of over strata.
    """
    if group is not None:
        key, on = [group], ["__all"]
        units = df.select(group).distinct().withColumn("__all", F.lit(1))
        df = df.withColumn("__all", F.lit(1))
    else:
        on, units = strata, df
    cuts = hash_cutpoints(units, on, key, fractions, seed)
    names = [f"cut_{i}" for i in range(len(fractions))]
    h = key_hash(key, seed)
    above = [F.when(h > F.coalesce(F.col(c), F.lit("")), 1).otherwise(0) for c in names]
    return (
        df.join(cuts, on, "left")
        .withColumn(name, reduce(lambda a, b: a + b, above).cast("int"))
        .drop(*names, "__all")
    )


def stratified_split(
    df: DataFrame,
    strata: list[str],
    key: list[str],
    test_fraction: float = 0.2,
    seed: int = 42,
    group: str | None = None,
) -> DataFrame:
    """Add ``is_test``: each stratum gives exactly ``round(test_fraction * n)`` rows to the test."""
    parts = hash_parts(df, strata, key, [test_fraction], seed, group, "__part")
    return parts.withColumn("is_test", F.col("__part") == 0).drop("__part")


def stratified_folds(
    df: DataFrame, strata: list[str], key: list[str], folds: int = 3, seed: int = 42
) -> DataFrame:
    """Add ``fold`` (0 to ``folds - 1``) of equal size within every stratum."""
    return hash_parts(df, strata, key, [i / folds for i in range(1, folds)], seed, name="fold")


def split_with_folds(
    df: DataFrame,
    strata: list[str],
    key: list[str],
    test_fraction: float = 0.2,
    folds: int = 3,
    seed: int = 42,
    group: str | None = None,
) -> DataFrame:
    """``is_test`` and, for the other rows, ``fold``, from one set of cut points."""
    rest = 1 - test_fraction
    fractions = [test_fraction + rest * i / folds for i in range(folds)]
    parts = hash_parts(df, strata, key, fractions, seed, group, "__part")
    return parts.withColumns(
        {
            "is_test": F.col("__part") == 0,
            "fold": F.greatest(F.col("__part") - 1, F.lit(0)),
        }
    ).drop("__part")


def seeded_sample(
    df: DataFrame, n: int, key: list[str], by: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """``n`` rows per group with the smallest key hash, numbered ``sample_no`` from 1.

    Spark keeps at most ``n`` rows per group and map task before the shuffle (window group limit),
    so a hot group costs no more than a small one.
    """
    w = W.partitionBy(*(by or [])).orderBy(key_hash(key, seed), *key)
    return df.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n)
