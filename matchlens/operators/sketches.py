"""Mergeable sketches: distinct counts and quantiles kept per batch and merged without a second scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.operators.pressure import rank_slopes
from matchlens.sources.storage import pinned

#: Base-two logarithm of the registers of a distinct-count sketch (HyperLogLog).
LOG_REGISTERS = 14
#: Size of a quantile sketch (KLL).
QUANTILE_K = 800

# --- fixed values: published error formulas of the two sketches ---
HLL_FACTOR = 1.04       # relative standard error, times the root of the registers
KLL_FACTOR = 2.296      # error of a rank with 99 % confidence, KLL_FACTOR / k ** KLL_POWER
KLL_POWER = 0.9021
# ------------------------------------------------------------------


def distinct_error(log_registers: int = LOG_REGISTERS) -> float:
    """Relative standard error of a distinct count."""
    return HLL_FACTOR / math.sqrt(2**log_registers)


def rank_error(k: int = QUANTILE_K) -> float:
    """By how much the rank of a quantile may be off (a share of the rows), with 99 % confidence."""
    return KLL_FACTOR / k**KLL_POWER


def sketch(
    rows: DataFrame, by: list[str], distinct: dict[str, Column], values: dict[str, Column], log_registers: int = LOG_REGISTERS, k: int = QUANTILE_K
) -> DataFrame:
    """One row per key with ``n`` rows, a sketch ``distinct_<name>`` and ``values_<name>`` for each column.

    With the batch among the keys the result can be stored and appended to, batch by batch. Sketches
    are built before the shuffle; a key with most of the rows is one small row per task. Nulls and
    NaN do not count.
    """
    counted = [F.hll_sketch_agg(c, log_registers).alias(f"distinct_{name}") for name, c in distinct.items()]
    ordered = {name: F.when(~F.isnan(c.cast("double")), c.cast("double")) for name, c in values.items()}
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *counted, *[F.kll_sketch_agg_double(c, k).alias(f"values_{name}") for name, c in ordered.items()]
    )


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of each key merged; any keys beside ``by`` are left out. Of one size for all rows."""
    merged = [
        (F.hll_union_agg(c) if c.startswith("distinct_") else F.kll_merge_agg_double(c)).alias(c)
        for c in sketches.columns if c.startswith(("distinct_", "values_"))
    ]
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *merged)


def distinct_count(name: str) -> Column:
    return F.hll_sketch_estimate(f"distinct_{name}")


def quantile(name: str, at: float) -> Column:
    """The value at a rank, null where no value was counted."""
    held = F.col(f"values_{name}")
    return F.when(F.kll_sketch_get_n_double(held) > 0, F.kll_sketch_get_quantile_double(held, F.lit(at)))


def share_above(name: str, value: float) -> Column:
    """The share of values above ``value``, null where no value was counted."""
    held = F.col(f"values_{name}")
    return F.when(F.kll_sketch_get_n_double(held) > 0, 1 - F.kll_sketch_get_rank_double(held, F.lit(float(value))))


def summarise_sketched_slopes(sketches: DataFrame, by: list[str]) -> DataFrame:
    """`pressure.summarise_slopes` from stored sketches of ``beta`` (``by, player, values_beta``, any batches).

    Each point's rank is off by `rank_error` at most, with 99 % confidence; a second run may give
    other points within it, because the sketch drops values by chance.
    """
    merged = merge(sketches, [*by, "player"]).select(
        *by, "player", quantile("beta", 0.5).alias("med"), quantile("beta", 0.025).alias("lo"), quantile("beta", 0.975).alias("hi"),
        share_above("beta", 0.0).alias("pr_pos"),
    )
    return rank_slopes(pinned(merged.where("med IS NOT NULL"), "slopes"), by)
