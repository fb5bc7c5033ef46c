"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALT, COPIES = "__salt", "__copies"
#: A key is heavy when it holds more than one part of so many parts of the rows.
PARTS = 64


def heavy_keys(df: DataFrame, on: list[str], parts: int = PARTS) -> DataFrame:
    """Keys with more than ``1 / parts`` of the rows, and over how many tasks to deal each.

    Rows are counted per key on the map side first. There are fewer than ``parts`` such keys, so
    the result is small whatever the input.
    """
    rows = df.count()
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.where(F.col("__n") * parts > rows).collect()
    heavy = [(*[r[c] for c in on], -(-r["__n"] * parts // rows)) for r in top]
    schema = T.StructType([df.schema[c] for c in on] + [T.StructField(COPIES, T.LongType())])
    return df.sparkSession.createDataFrame(heavy, schema)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    parts: int = PARTS,
) -> DataFrame:
    """Join a fact table to a per-key table, the rows of heavy keys of ``left`` dealt over tasks.

    Keys are counted first, so pass a stored ``left``. Only heavy keys are dealt, in proportion to
    their share, and only their rows of ``right`` are repeated; other keys join as they are. Rows
    with a null key are dealt like those of a heavy key. The salt is a hash of the ``spread``
    columns, so a recomputed task gives every row its old salt again.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the right side is repeated per salt, so {how} joins are not possible")
    spread = spread or [c for c in left.columns if c not in on]
    heavy = F.broadcast(heavy_keys(left, on, parts))  # fewer than `parts` rows
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    copies = F.when(missing, F.lit(parts)).otherwise(F.coalesce(COPIES, F.lit(1)))
    salt = F.when(copies > 1, F.pmod(F.xxhash64(*spread), copies)).otherwise(F.lit(0)).cast("int")
    salted_left = left.join(heavy, on, "left").withColumn(SALT, salt).drop(COPIES)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(COPIES, F.lit(1)).cast("int") - 1))
    salted_right = right.join(heavy, on, "left").withColumn(SALT, every).drop(COPIES)
    return salted_left.join(salted_right, [*on, SALT], how).drop(SALT)
