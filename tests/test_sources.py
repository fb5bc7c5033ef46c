from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchlens.functions import match as M
from matchlens.functions import text as TX
from matchlens.operators import features as FE
from matchlens.operators.joins import COPIES, heavy_keys, salted_join
from matchlens.schema import FEATURES, ROLES
from matchlens.sources import batches as B
from matchlens.sources import metrics_files as MF
from matchlens.sources import model_store as MS
from matchlens.sources import pages as PG
from matchlens.sources.storage import materialize
from matchlens.streaming.ingest import ingest


def one(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column).collect()]


def test_percent_texts(spark):
    texts = [("45.1%",), ("%5",), (" 7% ",), ("-",), (None,), ("12",)]
    got = one(spark, texts, "p string", M.percent_fraction("p"))
    assert got == [pytest.approx(0.451), 0.05, 0.07, None, None, 0.12]


def test_features_at_the_edges(spark):
    schema = ("kills int, deaths int, assists int, double_kills int, triple_kills int,"
              " quadra_kills int, penta_kills int, total_damage_taken double")
    rows = [(3, 0, 4, None, None, None, 1, 100.0), (0, 3, 2, 0, None, 0, 0, 100.0),
            (None, 1, 1, None, None, None, None, None)]
    got = FE.engineer_features(spark.createDataFrame(rows, schema)).collect()
    assert [(r.kde, r.multi_kill, r.dtpd) for r in got] == [
        (7.0, 1, 100.0), (0.5, 0, 25.0), (None, 0, None)]


@pytest.mark.parametrize("blue, red, winner, reject", [
    ("TEAM A - WIN", "TEAM B - LOSS", "TEAM A", None),
    ("TEAM A\nLOSS", "TEAM B - win", "TEAM B", None),
    ("TEAM A", "TEAM B", None, "no winner"),
    ("Unknown - WIN", "TEAM B - LOSS", "Unknown", "unknown team"),
    ("TEAM - A - WIN", "B", "TEAM", None),
])
def test_header_lines(spark, blue, red, winner, reject):
    df = spark.createDataFrame([(1, blue, red)], "game_id long, blue_text string, red_text string")
    r = PG.parse_headers(df).first()
    assert (r.winning_team, r.reject) == (winner, reject)


def page(game, n, kinds=("header", "stats"), winner="blue"):
    def row(name, cells):
        return f"<tr><td>{name}</td>" + "".join(f"<td><i>{c}</i>\n</td>" for c in cells) + "</tr>"

    labels = "<thead><tr><th></th>" + "<th>x</th>" * n + "</tr></thead>"
    stats = (f"<TABLE id=1>{labels}" + row("Player", [f"p{i}" for i in range(n)])
             + row("Kills", range(n)) + row("GD@15", ["-"] * n)
             + "</TABLE><table><tr><td>Player</td><td>other</td></tr></table>")
    blue, red = ("WIN", "LOSS") if winner == "blue" else ("LOSS", "WIN")
    header = (f"<div class='a blue-line-header'><a>T1</a> - {blue}</div>"
              f"<div class=\"red-line-header b\">T2 - {red}</div>")
    html = {"header": header, "stats": stats}
    return [(game, k, html[k]) for k in kinds]


def test_pages_of_nine_ten_and_eleven_players(spark):
    rows = page(1, 9) + page(2, 10) + page(3, 11) + page(4, 10, ("stats",)) + page(5, 10, winner="red")
    df = spark.createDataFrame(rows + page(2, 10), "game_id long, page_kind string, html string")
    got = PG.pages_to_player_games(df).orderBy("game_id", "slot").collect()
    assert [r.game_id for r in got] == [2] * 10 + [5] * 10
    assert [(r.slot, r.player, r.kills, r.gd_15, r.dpm) for r in got[:10]] == [
        (i, f"p{i}", i, None, None) for i in range(10)]
    assert [r.win for r in got] == [1] * 5 + [0] * 5 + [0] * 5 + [1] * 5
    assert {(r.blue_team, r.red_team) for r in got} == {("T1", "T2")}


def test_batches_by_name_with_gaps_copies_and_bad_numbers(spark, tmp_path):
    head = "Game_ID,Player,Role,Win,Kills,KP%,GD@15\n"
    (tmp_path / B.BASE_FILE).write_text(head + "1,a,Top,1,3,45.1%,\n3,c,Mid,1.0,3.0,-,nan\n")
    (tmp_path / B.BATCH_FILE.format(0)).write_text(head + "2,b,Mid,0,x,-,12.5\n4,d,ADC,0,2.5,-,1\n")
    (tmp_path / B.BATCH_FILE.format(11)).write_text("GD@15,Player,Game_ID,Extra\n7.5,a,1,e\n")
    assert len(B.existing_batches(spark, str(tmp_path))) == 3
    df, bad = B.load_batches_checked(spark, str(tmp_path))
    rows = {(r.game_id, r.player, r.kills, r.win, r.gd_15, r.batch_file) for r in df.collect()}
    assert rows == {
        (1, "a", None, None, 7.5, "all_matches_batch_11.csv"), (1, "a", 3, 1, None, "all_matches.csv"),
        (3, "c", 3, 1, None, "all_matches.csv")}
    assert sorted((r.game_id, r.kills) for r in bad.collect()) == [("2", "x"), ("4", "2.5")]
    kept = B.drop_copies(df, ["game_id", "player"])
    assert {(r.game_id, r.kills) for r in kept.collect()} == {(1, 3), (3, 3)}


def test_missing_base_file_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        B.load_batches(spark, str(tmp_path))


def test_pressure_input_as_it_is_stored(spark, tmp_path):
    head = "Game_ID,Player,bo5,final_games,Tourney,State,international,performance_score,own_team,opponent_team\n"
    (tmp_path / "d.csv").write_text(head + "1,a,True,False,t,Playoffs,1,0.5,A,B\n2,b,False,True,t,Regular,False,0.25,B,A\n3,c,maybe,True,t,Regular,0,1,B,A\n")
    rows, bad = B.read_pressure_input(spark, [str(tmp_path / "d.csv")])
    got = sorted((r.game_id, r.bo5, r.final3, r.international, r.performance_score) for r in rows.collect())
    assert got == [(1, True, False, True, 0.5), (2, False, True, False, 0.25)]
    assert [r.player for r in bad.collect()] == ["c"]


def test_metric_files_as_published(spark, tmp_path):
    for i, role in enumerate(ROLES):
        lines = ["AUC,F1_score,Log-Loss,Brier Score,Accuracy"] + [f"0.{i}{k},0.5,0.4,x,0.7" for k in range(5)]
        (tmp_path / f"metrics_{role}.csv").write_text("\r\n".join(lines) + "\r\n")
    rows = MF.read_metric_files(spark, str(tmp_path)).collect()
    assert len(rows) == 25 and {(r.role, r.row_no, r["auc-roc"]) for r in rows} == {
        (role, k, float(f"0.{i}{k}")) for i, role in enumerate(ROLES) for k in range(5)}
    assert {r["brier score"] for r in rows} == {None}
    named = MF.check_complete(MF.named_by_row(MF.read_metric_files(spark, str(tmp_path))))
    assert named.count() == 20
    (tmp_path / "metrics_Coach.csv").write_text("AUC\n1\n")
    with pytest.raises(KeyError):
        MF.read_metric_files(spark, str(tmp_path))


@pytest.mark.parametrize(("html", "want"), [
    ("<table><tr><td>a</td><td><table><tr><td>in<td>ner</table> b</td></tr><tr><td>c</td></tr></table><table><tr><td>x</table>",
     [["a", "in ner  b"], ["c"]]),
    ("<table><tr><td>1<table><tr><td>2<table><tr><td>3</table></table>4</td></tr></table>", [["1  2  3  4"]]),
    ("no table", []),
    ("<tablet><table>\n<TR class=x><TD colspan='3'>w</TD><td COLSPAN=2>v<td data-x='1'>u</TABLE><p>t", [["w", "w", "w", "v", "v", "u"]]),
    ("<table><tr><td>a<td>b<tr><th>l<td>c", [["a", "b"], ["l", "c"]]),  # no end tags at all
    ("<table><thead><tr><th>h<th>i</thead><tbody><tr><td>a</td> stray <td>b</td>junk</tr></tbody></table>", [["a", "b"]]),
    ("<table><tr><td colspan=0>z</td><td colspan=x>y</td><td></td></tr></table></table>", [["z", "y", ""]]),
    ("<table><td>loose</td></table>", [["loose"]]),
])
def test_first_table(spark, html, want):
    got = spark.createDataFrame([(html,)], "html string").select(PG.stat_grid().alias("g")).first().g
    assert [[" ".join(c.split()) for c in r] for r in got] == [[" ".join(c.split()) for c in r] for r in want]


def test_character_references_and_rejects(spark):
    texts = ["A &amp; B&#39;s", "&amp;lt; &amp;#39;", "&#x1F600;&#8364;", "&#xZZ; &# &#99999999; &", "&lt;&gt;&quot;&apos;", None, "plain"]
    want = ["A & B's", "&lt; &#39;", "\U0001f600\u20ac", "&#xZZ; &# &#99999999; &", "<>\"'", None, "plain"]
    assert one(spark, [(t,) for t in texts], "t string", PG.decoded(F.col("t"))) == want
    rows = page(1, 9) + page(2, 10) + page(4, 10, ("stats",)) + page(6, 10, ("header",))
    df = spark.createDataFrame(rows, "game_id long, page_kind string, html string")
    assert {(r.game_id, r.reject) for r in PG.page_rejects(df).collect()} == {
        (1, "wrong number of players"), (4, "no header page"), (6, "no stats page")}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join_on_a_hot_key(spark, how):
    left = spark.createDataFrame(
        [("hot", i) for i in range(60)] + [("b", 1), ("c", 2)], "k string, v int")
    right = spark.createDataFrame([("hot", 7), ("b", 8)], "k string, w int")
    plain = left.join(right, ["k"], how)
    salted = salted_join(left, right, ["k"], how)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_only_heavy_keys_are_dealt_by_their_share(spark):
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}", i) for i in range(3000)] + [(None, 1)] * 9, "k string, v int")
    heavy = heavy_keys(left, ["k"], parts=30).collect()
    assert [(r.k, r[COPIES]) for r in heavy] == [("hot", 10)]
    right = left.select("k").distinct().withColumn("w", F.length("k"))
    joined = salted_join(left, right, ["k"], "left", parts=30)
    assert joined.count() == 3009 and joined.where("w IS NULL").count() == 9
    assert heavy_keys(left.limit(0), ["k"]).count() == 0


def test_salted_join_refuses_to_repeat_the_outer_side(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        salted_join(df, df, ["id"], "full", spread=["id"])


def test_valid_games_counts_rows(spark):
    rows = [(g, p) for g, n in ((1, 9), (2, 10), (3, 11)) for p in range(n)]
    df = spark.createDataFrame(rows, "game_id long, p int")
    assert {r.game_id for r in B.valid_games(df).collect()} == {2}
    assert {(r.game_id, r.n_rows) for r in B.rejected_games(df).collect()} == {(1, 9), (3, 11)}


def test_dirty_rows_are_set_aside(spark):
    df = spark.createDataFrame([(1, "2"), (2, "x"), (3, None)], "id int, v string")
    clean, bad = B.split_dirty(df, ["v"])
    assert sorted((r.id, r.v) for r in clean.collect()) == [(1, 2.0), (3, None)]
    assert [(r.id, r.v) for r in bad.collect()] == [(2, "x")]


def test_nan_is_missing(spark):
    df = FE.nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert [r.x for r in df.collect()] == [1.0, None, None]


def test_minimum_samples_per_role(spark):
    rows = [(r,) for r, n in (("Top", 99), ("Mid", 100)) for _ in range(n)]
    kept = FE.enough_samples(spark.createDataFrame(rows, "role string"), 100)
    assert {r.role for r in kept.collect()} == {"Mid"}


def test_feature_report_names_what_is_missing(spark):
    df = spark.createDataFrame([(1.0, None)], "kde double, dpm double")
    got = {r.feature: (r.available, r.n_present) for r in FE.feature_report(df).collect()}
    assert set(got) == set(FEATURES)
    assert got["kde"] == (True, 1) and got["dpm"] == (True, 0) and got["gpm"] == (False, 0)


def test_role_spellings(spark):
    got = one(spark, [("adc",), (" MID ",), ("Coach",)], "r string", M.role_display("r"))
    assert got == ["ADC", "Mid", None]


@pytest.mark.parametrize("name, want", [
    ("AUC_ROC", "auc-roc"), ("roc auc", "auc-roc"), ("AUC", "auc-roc"), ("F1", "f1-score"),
    ("F1-score", "f1-score"), ("Log-Loss", "log loss"), ("Win%", "winpct"),
])
def test_metric_headers(name, want):
    assert TX.canonical_header(name) == want


def test_metric_files_with_three_rows(spark):
    df = spark.createDataFrame([("Top", i, 0.5) for i in range(3)], "role string, row_no int, a double")
    with pytest.raises(ValueError, match="at least 4 rows"):
        MF.check_complete(MF.named_by_row(df))


def test_extra_metric_rows_are_left_out(spark):
    df = spark.createDataFrame([("Top", i, float(i)) for i in range(6)], "role string, row_no int, a double")
    named = MF.check_complete(MF.named_by_row(df)).orderBy("row_no").collect()
    assert [r.model for r in named] == ["logistic", "random_forest", "xgboost", "neural_network"]


def test_inventory_lists_all_pairs(spark):
    df = spark.createDataFrame(
        [("x/top/logistic/a", 1048576), ("x/top/logistic/b", 524288), ("x/readme", 9)],
        "path string, length long").withColumn("path", F.concat(F.lit("/"), "path"))
    got = {(r.role, r.model_type): (r.file_size_mb, r.available) for r in MS.model_inventory(df).collect()}
    assert len(got) == 4 * len(ROLES)
    assert got[("top", "logistic")] == (1.5, True) and got[("adc", "xgboost")] == (0.0, False)


def test_materialize_builds_once_and_ignores_unfinished_folders(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = tmp_path / "t"
    path.mkdir()
    (path / "part-0.parquet").write_text("left over")
    assert materialize(spark, str(path), build).count() == 3
    assert materialize(spark, str(path), build).count() == 3
    assert len(calls) == 1


def test_materialize_rebuilds_when_inputs_or_settings_change(spark, tmp_path):
    source, path, calls = str(tmp_path / "in"), str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.read.schema("k int, v string").csv(source).withColumn("n", F.lit(len(calls)))

    def take(**settings):
        got = materialize(spark, path, build, [source], settings)
        return len(calls), sorted(r.k for r in got.collect())

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,x\n")
    assert take(p=1) == (1, [1]) and take(p=1) == (1, [1])
    (tmp_path / "in" / "a.csv").write_text("2,x\n3,y\n")  # a changed file
    assert take(p=1) == (2, [2, 3])
    (tmp_path / "in" / "b.csv").write_text("4,z\n")  # a new one
    assert take(p=1) == (3, [2, 3, 4])
    (tmp_path / "in" / "_note").write_text("hidden")
    assert take(p=1) == (3, [2, 3, 4])
    assert take(p=2) == (4, [2, 3, 4]) and take(p=2) == (4, [2, 3, 4])
    (tmp_path / "in" / "a.csv").unlink()
    assert take(p=2) == (5, [4])
    # a run that died after the table and before its manifest; a table without a marker
    from matchlens.sources import storage

    storage._write_manifest(spark, f"{path}.manifest", {})
    assert take(p=2) == (6, [4]) and take(p=2) == (6, [4])
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert take(p=2) == (7, [4])
    assert materialize(spark, path, build, [source], {"p": 2}).schema == spark.read.parquet(path).schema
    with pytest.raises(Exception, match="(?i)path"):
        materialize(spark, path, build, [str(tmp_path / "none")])


def test_stream_takes_each_file_once(spark, tmp_path):
    schema = ("k int, kills int, deaths int, assists int, double_kills int, triple_kills int,"
              " quadra_kills int, penta_kills int, total_damage_taken double, kp_pct string")
    dirs = [str(tmp_path / n) for n in ("in", "out", "progress")]
    for k in range(3):
        df = spark.createDataFrame([(k, 1, 0, 1, 0, 0, 0, 1, 5.0, "50%")], schema)
        df.write.mode("append").parquet(dirs[0])
        ingest(spark, *dirs, schema=df.schema).awaitTermination()
    got = spark.read.parquet(dirs[1]).orderBy("k").collect()
    assert [(r.k, r.kde, r.multi_kill, r.dtpd, r.kp_pct) for r in got] == [
        (k, 2.0, 1, 5.0, 0.5) for k in range(3)]


def test_a_page_is_parsed_once(spark):
    pages = spark.createDataFrame([(1, "stats", "<table><tr><td>A</td><td>&#65;&#x42;</td></tr></table>")], "game_id int, page_kind string, html string")
    parsed = PG.parsed_games(pages)
    plan = parsed._jdf.queryExecution().analyzed().toString()
    assert plan.count("thead|tbody|tfoot") == 1  # it ran five times for one page
    assert parsed.first().grid == [["A", "AB"]]


def test_characters_of_odd_references(spark):
    texts = {"&#65;;&#;x": "A;&#;x", "&#65\n;": "&#65\n;", "&#xD800;": "&#xD800;", "&#8;&#9;": "&#8;\t", "&amp;#65;": "&#65;", "a&#65b;c": "a&#65b;c",
             "&#1234567": "&#1234567", "&lt;&#38;lt;": "<<", "": "", "&#": "&#", "&#X4a;&nbsp;": "J\u00a0"}
    got = one(spark, [(t,) for t in texts], "t string", PG.decoded(F.col("t")))
    assert [g.replace("\u00a0", " ") for g in got] == [t.replace("\u00a0", " ") for t in texts.values()]


def test_text_is_parsed_once_and_by_short_code(spark, capsys):
    text = spark.createDataFrame([("1.0", "NaN", "x"), ("n/a", "2", "y"), (" 3 ", "", None)], "kills string, dpm string, player string")
    clean, bad = B.typed_columns(text)
    clean.explain()
    plan = capsys.readouterr().out
    assert plan.count("explode(") == 2 and plan.count("trim(kills") == 1  # the filter and the columns share one parse
    assert [tuple(r) for r in clean.select("kills", "dpm", "player").collect()] == [(1, None, "x"), (3, None, None)]
    assert [tuple(r) for r in bad.collect()] == [("n/a", "2", "y")]


def test_file_names_as_the_pattern_had_them(spark):
    paths = ["file:/a/all.csv/part-0.csv", "file:/a/all.csv/part-0", "s3://b/x.csv", "b/x.csv.gz", "x.csv", "/a.csv/b/c.csv", "/a.csv/b/c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    old = F.regexp_extract("p", r"([^/]*\.csv)(/[^/]*)?$", 1)
    assert df.where(~B.file_name(F.col("p")).eqNullSafe(old)).count() == 0


def test_rejects_count_players_without_grids(spark, monkeypatch):
    def stats(*rows):
        return "<table>" + "".join("<tr>" + "".join(f"<td{a}>{v}</td>" for a, v in r) + "</tr>" for r in rows) + "</table>"

    def row(name, n, span=""):
        return [("", name), *[("", "1")] * (n - 1), (span, "&#50;")]

    header = '<div class="blue-line-header">A - WIN</div><div class="red-line-header">B - LOSS</div>'
    two, three = stats(row("Kills", 2)), stats(row("Deaths", 1), row("Kills", 3))
    odd = [stats(row("Kills", 1, " colspan=2")), stats(row("Kills", 1, " colspan='0'")), "", None, "<table></table>", "<table><tr><td>x<td <b>y</table>",
           stats([("", "K")], row("Kills", 2)), "<TABLE><TR><TH>K<TH>1<TR><TD>K<TD>1<TD>2"]
    pages = [(i, "stats", html) for i, html in enumerate(odd)] + [(20, "stats", two)] * 2
    copies = [(21, "stats", two), (21, "stats", three), (22, "stats", "<table><tr><td>A</td></tr></table>"), (22, "stats", two), (None, "stats", two),
              (None, "stats", three), (23, None, two)]
    schema = "game_id int, page_kind string, html string"
    heads = [(i, "header", header) for i in (*range(len(odd)), 20, 21, 22, 23, None)]
    whole = spark.createDataFrame(pages + copies + heads, schema)
    grids = {r.game_id: r for r in PG.parsed_games(whole).select("game_id", "grid", PG.grid_players().alias("n")).collect()}
    want = {(i, "no stats page" if r.grid is None else "wrong number of players") for i, r in grids.items() if r.grid is None or r.n != 2}
    assert {(r.game_id, r.reject) for r in PG.page_rejects(whole, 2).collect()} == want and len(want) > 4
    alike = spark.createDataFrame(pages + heads, schema)
    monkeypatch.setattr(PG, "stat_grid", None)
    assert {(r.game_id, r.reject) for r in PG.page_rejects(alike, 2).collect() if r.game_id in range(20)} == {w for w in want if w[0] in range(20)}
