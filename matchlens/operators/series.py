"""Series of consecutive games between the same two teams, found from game order alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlens.functions.match import pair_high, pair_low
from matchlens.operators.joins import salted_join
from matchlens.operators.ordered import BUCKET, range_bucketed


def one_row_per_game(player_games: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Game table. Team and winner columns are constant in a game, so ``min`` takes any of them."""
    cols = ["blue_team", "red_team", "winning_team", *(extra or [])]
    return player_games.groupBy("game_id").agg(*[F.min(c).alias(c) for c in cols])


def series_flags(
    games: DataFrame, partition_cols: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """Per game: ``series_id, pos, series_len, bo5, final3``.

    A series is an unbroken run (in ``game_id`` order, within ``partition_cols`` if given) of games
    with the same unordered team pair. ``bo5`` holds for runs of four or more and for runs of three
    whose first two games have the same winner; ``final3`` marks the last three games of a run of
    four or more.

    Everything about a game follows from the last break at or before it and the first break after
    it. Both are running extremes, taken inside range buckets and carried between buckets by a
    summary with one row per bucket, so neither a long series nor the global order ever puts an
    unbounded number of games into one task.
    """
    part = partition_cols or []
    work = range_bucketed(
        games.select(
            *part,
            "game_id",
            pair_low().alias("ta"),
            pair_high().alias("tb"),
            F.col("winning_team").alias("win_team"),
        ),
        [*part, "game_id"],
        buckets,
    )

    up = W.partitionBy(BUCKET, *part).orderBy("game_id")
    down = W.partitionBy(BUCKET, *part).orderBy(F.desc("game_id"))
    local = (
        work.withColumn("rn", F.row_number().over(up).cast("long"))
        .withColumn("pta", F.lag("ta").over(up))
        .withColumn("ptb", F.lag("tb").over(up))
        .withColumn("next_win", F.lead("win_team").over(up))
        # NULL in the first row of a bucket: whether it breaks is only known across buckets.
        .withColumn(
            "brk",
            F.when(
                F.col("rn") > 1,
                ~(F.col("ta").eqNullSafe(F.col("pta")) & F.col("tb").eqNullSafe(F.col("ptb"))),
            ),
        )
        .withColumn("sweep", F.col("win_team") == F.col("next_win"))
    )

    at_break = F.when(F.col("brk"), F.struct("rn", "sweep", "win_team"))
    ends = F.struct("ta", "tb", "win_team")
    summary = local.groupBy(BUCKET, *part).agg(
        F.max("rn").alias("n"),
        F.min_by(ends, "rn").alias("head"),
        F.max_by(ends, "rn").alias("tail"),
        F.min_by("sweep", "rn").alias("head_sweep"),
        F.max(at_break).alias("last_break"),
        F.min(F.when(F.col("brk"), F.col("rn"))).alias("first_break"),
    )

    across = W.partitionBy(*part).orderBy(BUCKET)
    back = W.partitionBy(*part).orderBy(F.desc(BUCKET))
    prev = F.lag("tail").over(across)
    summary = (
        summary.withColumn(
            "offset",
            F.coalesce(F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("total", F.sum("n").over(W.partitionBy(*part)))
        .withColumn(
            "head_brk",
            ~(
                F.col("head.ta").eqNullSafe(prev["ta"])
                & F.col("head.tb").eqNullSafe(prev["tb"])
                & prev.isNotNull()
            ),
        )
        .withColumn("next_head_win", F.lead("head.win_team").over(across))
        # A game that ends its bucket is compared with the first winner of the next bucket.
        .withColumn("tail_sweep", F.col("tail.win_team") == F.col("next_head_win"))
        .withColumn(
            "head_sweep",
            F.when(F.col("n") == 1, F.col("tail_sweep")).otherwise(F.col("head_sweep")),
        )
        .withColumn(
            "head_start",
            F.when(
                F.col("head_brk"),
                F.struct((F.col("offset") + 1).alias("rn"), F.col("head_sweep").alias("sweep")),
            ),
        )
        .withColumn(
            "latest",
            F.coalesce(
                F.when(
                    F.col("last_break").isNotNull(),
                    F.struct(
                        (F.col("offset") + F.col("last_break.rn")).alias("rn"),
                        F.when(F.col("last_break.rn") == F.col("n"), F.col("tail_sweep"))
                        .otherwise(F.col("last_break.sweep"))
                        .alias("sweep"),
                    ),
                ),
                F.col("head_start"),
            ),
        )
        .withColumn(
            "earliest",
            F.col("offset") + F.when(F.col("head_brk"), 1).otherwise(F.col("first_break")),
        )
        .withColumn(
            "carry_start",
            F.coalesce(
                F.col("head_start"),
                F.max("latest").over(across.rowsBetween(W.unboundedPreceding, -1)),
            ),
        )
        .withColumn(
            "carry_next", F.min("earliest").over(back.rowsBetween(W.unboundedPreceding, -1))
        )
    )

    carried = summary.select(
        BUCKET, *part, "n", "offset", "total", "tail_sweep", "carry_start", "carry_next"
    )
    so_far = up.rowsBetween(W.unboundedPreceding, 0)
    later = down.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        local.withColumn(
            "own_start", F.max(F.when(F.col("brk"), F.struct("rn", "sweep"))).over(so_far)
        )
        .withColumn("own_next", F.min(F.when(F.col("brk"), F.col("rn"))).over(later))
        .join(carried, [BUCKET, *part])
        .withColumn(
            "start",
            F.coalesce(
                F.when(
                    F.col("own_start").isNotNull(),
                    F.struct(
                        (F.col("offset") + F.col("own_start.rn")).alias("rn"),
                        F.when(F.col("own_start.rn") == F.col("n"), F.col("tail_sweep"))
                        .otherwise(F.col("own_start.sweep"))
                        .alias("sweep"),
                    ),
                ),
                F.col("carry_start"),
            ),
        )
        .withColumn(
            "next_start",
            F.coalesce(
                F.col("offset") + F.col("own_next"), F.col("carry_next"), F.col("total") + 1
            ),
        )
    )
    pos = F.col("offset") + F.col("rn") - F.col("start.rn") + 1
    length = F.col("next_start") - F.col("start.rn")
    return rows.select(
        *part,
        "game_id",
        F.col("start.rn").alias("series_id"),
        pos.alias("pos"),
        length.alias("series_len"),
        "start.sweep",
    ).select(
        *part,
        "game_id",
        "series_id",
        "pos",
        "series_len",
        (
            (F.col("series_len") >= 4)
            | ((F.col("series_len") == 3) & F.coalesce("sweep", F.lit(False)))
        ).alias("bo5"),
        ((F.col("series_len") >= 4) & (F.col("pos") > F.col("series_len") - 3)).alias("final3"),
    )


def with_series_flags(
    player_games: DataFrame, flags: DataFrame, spread: list[str]
) -> DataFrame:
    """Attach ``bo5`` and ``final3`` to every player row (rows of unknown games keep NULL)."""
    return salted_join(
        player_games,
        flags.select("game_id", "bo5", "final3"),
        ["game_id"],
        "left",
        spread=spread,
    )
