from __future__ import annotations

import time

import pytest

from matchlens.sources.batches import drop_copies, rejected_games, valid_games
from matchlens.streaming import games
from matchlens.streaming.ingest import read_landing

SCHEMA = "game_id long, player string, kills int, deaths int, batch_file string"


def rows_of(game, n, file="all_matches_batch_1.csv", kills=1, start=0):
    return [(game, f"p{i}", kills, None if kills is None else 2, file) for i in range(start, start + n)]


@pytest.fixture
def landing(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("in", "out", "progress")}

    def run(rows=(), **settings):
        df = spark.createDataFrame(list(rows), SCHEMA)
        if rows:
            df.coalesce(1).write.mode("append").parquet(paths["in"])
        query = games.ingest_games(
            spark, read_landing(spark, paths["in"], df.schema), paths["out"], paths["progress"], ["game_id", "player"],
            **{"players": 4, **settings},
        )
        assert query.awaitTermination(60)
        return df

    return run, paths


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_split_and_overlapping_files_give_the_batch_result(spark, landing):
    run, paths = landing
    first = rows_of(1, 4) + rows_of(2, 2) + rows_of(3, 3, kills=None) + rows_of(4, 6) + rows_of(5, 1) + rows_of(6, 4)
    second = rows_of(2, 4, "all_matches.csv") + rows_of(1, 2) + rows_of(3, 2, "z.csv") + rows_of(4, 1)  # game 3: fuller copies
    third = rows_of(3, 4, "all_matches.csv", kills=None) + rows_of(2, 4) + rows_of(6, 1, start=7)  # game 6 turns out too large
    whole = [run(part) for part in (first, second, third)]
    everything = whole[0].unionByName(whole[1]).unionByName(whole[2])
    batch = drop_copies(everything, ["game_id", "player"])
    got, bad = games.settled(spark, paths["out"], f"{paths['out']}-rejects", ["game_id", "player"])
    assert found(got.select(batch.columns)) == found(valid_games(batch, 4, ["player"]).select(batch.columns))
    over = {r.game_id for r in rejected_games(batch, 4).where("n_rows > 4").collect()}
    assert {r.game_id for r in bad.collect()} == over == {4, 6}
    assert {r[games.REASON] for r in bad.collect()} == {"too many players"}
    assert found(bad.select("game_id", "player")) == found(batch.where("game_id in (4, 6)").select("game_id", "player"))
    run()  # nothing new: nothing is written twice
    assert games.read_games(spark, paths["out"]).count() == 16


def test_incomplete_games_time_out_and_null_ids_are_a_game(spark, landing):
    run, paths = landing
    run(rows_of(1, 3) + rows_of(None, 4) + rows_of(2, 4), patience_ms=2000)
    assert {r.game_id for r in games.read_games(spark, paths["out"]).collect()} == {None, 2}
    time.sleep(3)
    run(rows_of(3, 4), patience_ms=2000)
    bad = games.read_games(spark, f"{paths['out']}-rejects").collect()
    assert sorted((r.game_id, r.player, r[games.REASON]) for r in bad) == [(1, f"p{i}", "incomplete") for i in range(3)]


def test_a_game_id_of_many_rows_is_not_held(spark, landing):
    run, paths = landing
    run(rows_of(9, 3000) + rows_of(1, 4))
    assert games.read_games(spark, f"{paths['out']}-rejects").count() == 3000
    assert games.read_games(spark, paths["out"]).count() == 4


def test_outcomes_need_one_shuffle_and_no_python_state(spark, capsys):
    rows = spark.createDataFrame(rows_of(1, 4) + rows_of(2, 2) + rows_of(2, 2, kills=None) + rows_of(3, 1) + rows_of(5, 2), SCHEMA)
    keys = ["game_id", "player"]
    known = [(3, ("whole", 7, [(3, "p0"), (3, "p1")])), (4, ("waiting", 7, [])), (5, ("too many players", 7, []))]
    state = f"game_id long, {games.STATE} struct<status string, since long, keys array<struct<game_id long, player string>>>"
    done = games.game_outcomes(rows, spark.createDataFrame(known, state), keys, now=10, players=4, patience_ms=1)
    done.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Python" not in plan and "TransformWithState" not in plan
    outcomes = sorted(done.groupBy("game_id", games.OUTCOME).count().collect())
    assert outcomes == [(1, "whole", 4), (2, "waiting", 2), (5, "too many players", 2)]  # game 3: a copy
    states = {r.game_id: (r[games.STATE].status, len(r[games.STATE]["keys"])) for r in games.game_states(done, keys, now=10).collect()}
    assert states == {1: ("whole", 4), 2: ("waiting", 0)}
