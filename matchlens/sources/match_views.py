"""Match-shaped views over a star schema (orders = games, line items = player rows).

The texts use only SQL that Spark and DuckDB both run; ``{orders}`` and the like stand for the
tables. Series of 5, 4, 3, 2 and 1 games come from the order key, sides swap between games, and
the side with more quantity wins, so the features carry a learnable signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GAMES = """
SELECT k AS game_id,
       CASE WHEN k % 2 = 0 THEN a.n_name ELSE b.n_name END AS blue_team,
       CASE WHEN k % 2 = 0 THEN b.n_name ELSE a.n_name END AS red_team,
       o_orderpriority, o_orderstatus, o_custkey
FROM (SELECT k, o_orderpriority, o_orderstatus, o_custkey,
             (blk * 5 + s) % 25 AS t1, (blk * 5 + s + 7) % 25 AS t2
      FROM (SELECT o_orderkey AS k, o_orderpriority, o_orderstatus, o_custkey,
                   CAST(floor(o_orderkey / 15) AS BIGINT) AS blk,
                   CASE WHEN o_orderkey % 15 < 5 THEN 0 WHEN o_orderkey % 15 < 9 THEN 1
                        WHEN o_orderkey % 15 < 12 THEN 2 WHEN o_orderkey % 15 < 14 THEN 3
                        ELSE 4 END AS s
            FROM {orders}) x) y
JOIN {nation} a ON a.n_nationkey = t1 JOIN {nation} b ON b.n_nationkey = t2
"""

PLAYER_GAMES = """
SELECT g.game_id, l.l_linenumber AS slot, l.l_partkey AS part_no, l.l_suppkey AS supp_no,
       CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-'
         || CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) AS row_key,
       s.s_name AS player,
       'P' || CAST(l.l_partkey * 7 + l.l_suppkey % 7 AS STRING) AS thin_player,
       CASE (l.l_linenumber - 1) % 5 WHEN 0 THEN 'Top' WHEN 1 THEN 'Jungle' WHEN 2 THEN 'Mid'
            WHEN 3 THEN 'ADC' ELSE 'Support' END AS role,
       g.blue_team, g.red_team,
       CASE WHEN w.bq >= w.rq THEN g.blue_team ELSE g.red_team END AS winning_team,
       CASE WHEN (l.l_linestatus = 'O') = (w.bq >= w.rq) THEN 1 ELSE 0 END AS win,
       CAST(floor(l.l_quantity / 5) AS INT) AS kills,
       CAST(l.l_partkey % 9 AS INT) AS deaths,
       CAST(l.l_suppkey % 20 AS INT) AS assists,
       CASE WHEN l.l_quantity >= 45 THEN 1 ELSE 0 END AS double_kills,
       CASE WHEN l.l_quantity >= 48 THEN 1 ELSE 0 END AS triple_kills,
       CASE WHEN l.l_quantity >= 49 THEN 1 ELSE 0 END AS quadra_kills,
       CASE WHEN l.l_quantity >= 50 THEN 1 ELSE 0 END AS penta_kills,
       l.l_extendedprice AS total_damage_taken,
       CAST(CAST(round(l.l_discount * 100) AS INT) AS STRING) || '%' AS dmg_pct,
       CAST(CAST(round(l.l_tax * 100) AS INT) AS STRING) || '%' AS kp_pct,
       l.l_extendedprice / 40 AS dpm, l.l_quantity * 8 AS gpm,
       l.l_tax * 20 AS vspm, l.l_discount * 10 AS wcpm,
       CASE WHEN l.l_partkey % 50 = 0 THEN NULL
            ELSE CAST(l.l_partkey % 2001 AS DOUBLE) - 1000 END AS gd_15,
       CAST(l.l_suppkey % 41 AS DOUBLE) - 20 AS xpd_15,
       CAST(l.l_partkey % 31 AS DOUBLE) - 15 AS csd_15,
       CAST(l.l_linenumber AS DOUBLE) - 4 AS lvld_15,
       CASE WHEN g.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Playoffs'
            ELSE 'Regular' END AS state,
       CASE WHEN g.o_orderstatus = 'P' THEN 1 ELSE 0 END AS international,
       g.o_orderpriority AS tourney,
       round(l.l_discount * 10, 1) AS performance_score
FROM {lineitem} l
JOIN (""" + GAMES + """) g ON g.game_id = l.l_orderkey
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
JOIN (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS bq,
             sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS rq
      FROM {lineitem} GROUP BY l_orderkey) w ON w.l_orderkey = l.l_orderkey
"""

PREDICTIONS = """
SELECT role, model, row_key, label, probability,
       CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT CASE (l_linenumber - 1) % 5 WHEN 0 THEN 'Top' WHEN 1 THEN 'Jungle' WHEN 2 THEN 'Mid'
                  WHEN 3 THEN 'ADC' ELSE 'Support' END AS role,
             CASE l_partkey % 4 WHEN 0 THEN 'logistic' WHEN 1 THEN 'random_forest'
                  WHEN 2 THEN 'xgboost' ELSE 'neural_network' END AS model,
             CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
               || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS row_key,
             CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
             (l_quantity + CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END + l_discount * 5) / 61.0
               AS probability
      FROM {lineitem}) x
"""

HEADER_TEXT = """
SELECT game_id,
       CASE WHEN game_id % 97 = 0 THEN 'Unknown' ELSE blue_team END
         || CASE WHEN game_id % 101 = 0 THEN '' WHEN blue_won THEN ' - WIN' ELSE ' - LOSS' END
         AS blue_text,
       red_team || CASE WHEN game_id % 101 = 0 THEN '' WHEN blue_won THEN ' - LOSS'
                        ELSE ' - WIN' END AS red_text
FROM (SELECT game_id, blue_team, red_team, o_custkey % 2 = 0 AS blue_won
      FROM (""" + GAMES + """) g) h
"""

_TABLES = ["nation", "supplier", "orders", "lineitem"]
#: Where games and rows meet, both are dealt out by the order key: their join and the sums per game
#: then need no further shuffle.
_ORDER_KEY = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def tables(spark: SparkSession, sf_dir: str, names=_TABLES) -> dict[str, DataFrame]:
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    if not set(_ORDER_KEY) <= set(names):
        return read
    return {t: df.repartition(_ORDER_KEY[t]) if t in _ORDER_KEY else df for t, df in read.items()}


def dealt(orders: DataFrame) -> DataFrame:
    """A file read by one task, over all cores: a number of partitions that is given is not merged again."""
    n = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.select("o_orderkey", "o_custkey").repartition(max(n, orders.sparkSession.sparkContext.defaultParallelism), "o_orderkey")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = [t for t in _TABLES if "{" + t + "}" in text]
    return spark.sql(text, **tables(spark, sf_dir, used))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GAMES)


def player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PLAYER_GAMES)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PREDICTIONS)


def header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HEADER_TEXT)


def plain_sql(text: str) -> str:
    """The same text for an engine where the tables are views under their own names."""
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return text


# ---- fixed coefficients of the linear scorers (any numbers do; they only have to be fixed) ------

BASE_COEFFICIENTS = {
    "kde": 0.9, "dpm": 0.4, "multi_kill": 0.2, "gpm": 0.7, "vspm": -0.1, "wcpm": 0.3,
    "gd_15": 0.6, "xpd_15": 0.25, "csd_15": -0.2, "lvld_15": 0.15, "dtpd": -0.5,
}


def linear_models(roles, models) -> list[tuple]:
    """``(role, model, intercept, coefficients ...)``, different for every role and model."""
    rows = []
    for i, role in enumerate(roles):
        for j, model in enumerate(models):
            coefficients = [
                round(b * (1 + 0.1 * i) * (1 - 0.15 * j) + 0.05 * ((i + j + n) % 3), 6)
                for n, b in enumerate(BASE_COEFFICIENTS.values())
            ]
            rows.append((role, model, round(0.1 * (i - j), 6), *coefficients))
    return rows


# ---- stored result pages: one header and one stats page per order ------------------------------

#: Stat name on the page -> value in terms of the game ``k`` and the player's ``slot``.
PAGE_VALUES = {
    "Player": "'S' || CAST(o_custkey % 500 + slot AS STRING)",
    "Role": "CASE slot % 5 WHEN 0 THEN 'Top' WHEN 1 THEN 'Jungle' WHEN 2 THEN 'Mid'"
            " WHEN 3 THEN 'ADC' ELSE 'Support' END",
    "Kills": "CAST((k + 3 * slot) % 15 AS STRING)",
    "Deaths": "CAST((2 * k + slot) % 9 AS STRING)",
    "Assists": "CAST((k + 5 * slot) % 20 AS STRING)",
    "Double kills": "CASE WHEN (k + 3 * slot) % 15 > 9 THEN '1' ELSE '0' END",
    "Total damage taken": "CAST(9000 + (k * 17 + slot * 31) % 30000 AS STRING)",
    "KP%": "CAST((k + slot) % 90 AS STRING) || '.5%'",
    "DPM": "CAST((k * 7 + slot * 11) % 900 AS STRING) || '.25'",
    "GD@15": "CASE WHEN (k + slot) % 50 = 0 THEN '-'"
             " ELSE CAST((k * 13 + slot) % 2001 - 1000 AS STRING) END",
}

#: Players on the page of game ``k``: ten, but nine or eleven on some pages.
PAGE_PLAYERS = "CASE WHEN k % 89 = 0 THEN 9 WHEN k % 83 = 0 THEN 11 ELSE 10 END"


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``game_id, page_kind, html`` for every order, built from the order's columns."""
    cells = " || ".join(
        f"'<tr><td>{name}</td>' || array_join(transform(sequence(0, players - 1),"
        f" slot -> '<td><b>' || replace({value}, 'S', '&#x53;') || '</b></td>'), '') || '</tr>'"
        for name, value in PAGE_VALUES.items()
    )
    stats = spark.sql(
        f"SELECT k AS game_id, 'stats' AS page_kind, '<html><body><table class=\"stats\">' "
        f"|| {cells} || '</table><table><tr><td>Kills</td><td>0</td></tr></table></body></html>' "
        f"AS html FROM (SELECT o_orderkey AS k, o_custkey, {PAGE_PLAYERS} AS players FROM {{orders}})",
        orders=dealt(tables(spark, sf_dir, ["orders"])["orders"]),
    )
    header = header_text(spark, sf_dir).selectExpr(
        "game_id",
        "'header' AS page_kind",
        """'<html><div class="col-12 blue-line-header"><a href="#">' || replace(blue_text, 'I', '&#73;')
           || '</a></div><div class="col-12 red-line-header">' || replace(red_text, ' ', '&nbsp;') || '</div></html>'
           AS html""",
    )
    return stats.unionByName(header)
