"""Whole games from a stream of player rows.

A game's rows are held in a state table until all its players are there, however the files cut it.
Copies of a row, within a run or from an overlapping file of a later run, meet there and the
fullest stays. Games that stay incomplete are handed to the rejects after a while.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from matchlens.schema import PLAYERS_PER_GAME
from matchlens.sources.batches import drop_copies

#: Column that says why a row is in the rejects.
REASON = "reject_reason"
WHOLE, WAITING, OVER, LATE, INCOMPLETE = "whole", "waiting", "too many players", "late", "incomplete"
STATE, OUTCOME = "__state", "__outcome"


def state_type(rows: DataFrame, row_keys: list[str]) -> T.StructType:
    """What is remembered of a game: how it stands, since when, and the row keys of a whole one."""
    key = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in row_keys])
    return T.StructType([
        T.StructField("status", T.StringType()), T.StructField("since", T.LongType()), T.StructField("keys", T.ArrayType(key)),
    ])


def game_outcomes(
    rows: DataFrame, states: DataFrame, row_keys: list[str], now: int, game: str = "game_id", players: int = PLAYERS_PER_GAME,
    patience_ms: int = 86_400_000,
) -> DataFrame:
    """The `rows` of a run, those held before included, without copies and with ``__outcome`` and ``__state``.

    `states` has a row (game, ``__state``) per game that is held or remembered. Rows and states meet in one
    shuffle by game. Copies of rows of a whole game are left out. A null game id is a game.
    """
    whole = rows.withColumn(STATE, F.lit(None).cast(state_type(rows, row_keys))).withColumn("__row", F.lit(True))
    met = whole.unionByName(states.withColumn("__row", F.lit(False)), allowMissingColumns=True).repartition(game)
    own = W.partitionBy(game)
    known = drop_copies(met, [game, "__row", *row_keys]).withColumns({
        STATE: F.max(STATE).over(own), "__n": F.count_if("__row").over(own),
    })
    status = F.col(f"{STATE}.status")
    since = F.coalesce(F.when(status == WAITING, F.col(f"{STATE}.since")), F.lit(now))
    outcome = (
        F.when(status == OVER, OVER)
        .when(status == WHOLE, F.when(~F.array_contains(f"{STATE}.keys", F.struct(*row_keys)), LATE))
        .when(F.col("__n") > players, OVER)
        .when(F.col("__n") == players, WHOLE)
        .when(since + patience_ms <= now, INCOMPLETE)
        .otherwise(WAITING)
    )
    fresh = F.coalesce(status, F.lit(WAITING)) == WAITING  # else the game is remembered already
    kept = known.where("__row").withColumn(OUTCOME, outcome).where(F.col(OUTCOME).isNotNull())
    return kept.select(*rows.columns, OUTCOME, since.alias("__since"), fresh.alias("__fresh"))


def game_states(settled_rows: DataFrame, row_keys: list[str], now: int, game: str = "game_id") -> DataFrame:
    """A row (game, ``__state``) for every game of `game_outcomes` that is held or newly let go."""
    status, key = F.col(OUTCOME), F.struct(*row_keys)
    since = F.when(status == WAITING, F.col("__since")).otherwise(F.lit(now))
    new = settled_rows.where(F.col("__fresh") & (status != INCOMPLETE))
    states = new.groupBy(game, status.alias("status"), since.alias("since")).agg(F.collect_list(F.when(status == WHOLE, key)).alias("keys"))
    return states.select(game, F.struct("status", "since", "keys").alias(STATE))


def ingest_games(
    spark: SparkSession, rows: DataFrame, out: str, progress: str, row_keys: list[str], rejects: str | None = None,
    game: str = "game_id", players: int = PLAYERS_PER_GAME, patience_ms: int = 86_400_000, memory_ms: int = 30 * 86_400_000,
) -> StreamingQuery:
    """Drain the stream `rows`: whole games to `out`, the other rows to `rejects` (default: beside `out`).

    A game is let go when it has all `players` distinct `row_keys` at the end of a micro-batch; copies of its
    rows that come later are dropped, other rows of it are ``late``. A game with more rows is ``too many
    players`` and its later rows are too. A game not whole within `patience_ms` is ``incomplete``, and starts
    afresh if rows of it come again. What has been let go is remembered for `memory_ms`. Games whose time is
    over go with the next batch, that is when new files come.

    Rows, held rows and the states of games are tables with a folder per micro-batch beside `progress`; a
    micro-batch reads what the ones before it left. A repeated batch overwrites its own folders, so each row
    is written once whatever fails; read the outputs with `read_games` or `settled`.
    """
    rejects = rejects or f"{out.rstrip('/')}-rejects"
    held, states = f"{progress}-batches", f"{progress}-states"
    game_state = T.StructType([rows.schema[game], T.StructField(STATE, state_type(rows, row_keys))])

    def write(batch: DataFrame, number: int) -> None:
        now, session = int(time.time() * 1000), batch.sparkSession
        before = session.createDataFrame([], game_state)
        if number > 0:
            stored = session.read.schema(T.StructType([*game_state.fields, T.StructField("batch", T.IntegerType())])).parquet(states)
            waits = F.col(f"{STATE}.status") == WAITING
            last = waits & (F.col("batch") == number - 1)
            remembered = ~waits & (F.col("batch") < number) & (F.col(f"{STATE}.since") + memory_ms > now)
            before = stored.where(last | remembered).drop("batch")
            again = session.read.schema(marked_schema).parquet(f"{held}/batch={number - 1}")
            batch = batch.unionByName(again.where(F.col(OUTCOME) == WAITING).select(batch.columns))
        marked = game_outcomes(batch, before, row_keys, now, game, players, patience_ms)
        marked.write.mode("overwrite").partitionBy(OUTCOME).parquet(f"{held}/batch={number}")
        done = session.read.schema(marked_schema).parquet(f"{held}/batch={number}")
        outcome, plain = F.col(OUTCOME), batch.columns
        done.where(outcome == WHOLE).select(plain).write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad = done.where(outcome.isin(OVER, LATE, INCOMPLETE)).select(*plain, outcome.alias(REASON))
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        game_states(done, row_keys, now, game).write.mode("overwrite").parquet(f"{states}/batch={number}")

    marked_schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in rows.schema.fields], T.StructField("__since", T.LongType()),
        T.StructField("__fresh", T.BooleanType()), T.StructField(OUTCOME, T.StringType()),
    ])
    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all micro-batches."""
    return spark.read.parquet(path).drop("batch")


def settled(spark: SparkSession, out: str, rejects: str, row_keys: list[str], game: str = "game_id") -> tuple[DataFrame, DataFrame]:
    """Whole games and rejected rows as a batch over all files would give them.

    A late row shows that a game which was let go as whole has too many players: its rows are moved to
    the rejects. Of rejected copies the fullest stays.
    """
    whole, bad = read_games(spark, out), read_games(spark, rejects)
    over = bad.where(F.col(REASON).isin("late", "too many players")).select(F.col(game).alias("__game")).distinct()
    same = F.col(game).eqNullSafe(F.col("__game"))
    moved = whole.join(over, same, "left_semi").withColumn(REASON, F.lit("too many players"))
    reason = F.when(F.col(REASON) == "late", "too many players").otherwise(F.col(REASON))
    return whole.join(over, same, "left_anti"), drop_copies(bad.withColumn(REASON, reason).unionByName(moved), row_keys)
