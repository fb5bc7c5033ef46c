"""Totally ordered running sums, lags and ranks without a one-partition window.

The rows are range-partitioned on the full order (Spark samples the bounds, so a hot group is
cut into as many buckets as its size needs), the bucket number is pinned by writing the rows,
the window runs inside each bucket, and one summary row per bucket and group carries the state from
bucket to bucket. The summary has one row per bucket plus at most one more per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlens.sources.storage import pinned

BUCKET = "__bucket"


def range_bucketed(df: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """Rows with a bucket number that rises along ``order`` (whose values must be unique).

    Without ``buckets`` there are as many as there are shuffle partitions, less what adaptive
    execution merges because the data is small.
    """
    ranged = df.repartitionByRange(*([buckets] if buckets else []), *order)
    return pinned(ranged.withColumn(BUCKET, F.spark_partition_id()), "ordered")


def ordered_scan(
    df: DataFrame,
    order: list[str],
    groups: list[str] | None = None,
    sums: dict[str, Column] | None = None,
    lags: dict[str, str] | None = None,
    totals: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add exclusive running sums and previous-row values along ``order`` within ``groups``.

    ``sums`` maps a new column to a non-null summand: the new column is the sum over all earlier
    rows of the group (with ``totals`` also ``<name>_total``, the sum over the group). ``lags``
    maps a new column to the column whose value in the previous row it takes.
    """
    groups, sums, lags = groups or [], sums or {}, lags or {}
    work = range_bucketed(
        df.select("*", *[c.alias(f"__v_{k}") for k, c in sums.items()]), [*groups, *order], buckets
    )
    inside = W.partitionBy(BUCKET, *groups).orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    local = work.select(
        "*",
        *[F.sum(f"__v_{k}").over(before).alias(f"__s_{k}") for k in sums],
        *[F.lag(c).over(inside).alias(f"__l_{k}") for k, c in lags.items()],
        F.row_number().over(inside).alias("__first"),
    )

    key = F.struct(*order)
    summary = work.groupBy(BUCKET, *groups).agg(
        *[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums],
        *[F.max_by(F.col(c), key).alias(f"__e_{k}") for k, c in lags.items()],
        F.count(F.lit(1)).alias("__n"),
    )
    across = W.partitionBy(*groups).orderBy(BUCKET)
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*groups)
    carry = summary.select(
        BUCKET,
        *groups,
        *[F.sum(f"__t_{k}").over(earlier).alias(f"__c_{k}") for k in sums],
        *[F.lag(f"__e_{k}").over(across).alias(f"__p_{k}") for k in lags],
        *([F.sum(f"__t_{k}").over(everything).alias(f"{k}_total") for k in sums] if totals else []),
    )
    out = local.join(carry, [BUCKET, *groups])
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[
            (F.coalesce(f"__s_{k}", zero) + F.coalesce(f"__c_{k}", zero)).alias(k) for k in sums
        ],
        *[
            F.when(F.col("__first") == 1, F.col(f"__p_{k}")).otherwise(F.col(f"__l_{k}")).alias(k)
            for k in lags
        ],
        *([f"{k}_total" for k in sums] if totals else []),
    )


def ranked(
    df: DataFrame,
    order: list[str],
    groups: list[str] | None = None,
    name: str = "rank",
    count: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Row number (from 1) along a unique ``order`` within ``groups``; ``count`` adds group size."""
    out = ordered_scan(
        df, order, groups, sums={name: F.lit(1).cast("long")},
        totals=count is not None, buckets=buckets,
    ).withColumn(name, F.col(name) + 1)
    return out.withColumnRenamed(f"{name}_total", count) if count else out


def ntile_of(rank: str, count: str, tiles: int) -> Column:
    """SQL ``ntile`` computed from a row number and a group size."""
    r, n = F.col(rank), F.col(count)
    size = F.floor(n / tiles)
    extra = n % tiles
    wide = extra * (size + 1)
    return F.when(r <= wide, F.floor((r - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((r - wide - 1) / F.greatest(size, F.lit(1))) + 1
    ).cast("long")
