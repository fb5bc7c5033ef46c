"""Result pages (stored HTML) to player-game rows.

A game has a header page with both teams' result lines and a stats page whose first table has one
row per stat and one column per player. A page is parsed inside its own row, so the only shuffle
is the join of a game's header with its stats page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.match import win_by_slot
from matchlens.functions.text import team_from_header, winner_from_headers
from matchlens.schema import (
    DOUBLE_STATS,
    INT_STATS,
    PAGE_STATS,
    PLAYERS_PER_GAME,
    PLAYERS_PER_TEAM,
)
from matchlens.sources.storage import pinned

# --- fixed values: patterns of the page layout ------------------------------
FROM_TABLE = r"(?is)<table[\s>].*"
TABLE_TAG = r"(?i)(?=</?table[\s>])"
ROW = r"(?i)<tr(?:\s[^>]*)?>"
CELL = r"(?i)<t([dh])(?=[\s>])(?:[^>]*?\scolspan\s*=\s*[\"']?\s*([0-9]{1,4}))?[^>]*>"
CELL_END = r"(?i)</(?:t[dhr]|thead|tbody|tfoot)\s*>"
HEADER_LINE = r"(?is)<div[^>]*class=['\"][^'\"]*{}-line-header[^'\"]*['\"][^>]*>(.*?)</div>"
TAG = r"<[^>]*>"
#: Named character references and their texts; the ampersand comes last, so that nothing is read twice.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
# ----------------------------------------------------------------------------

# Control characters that stand for the table's structure once its tags are gone.
_TEXT, _CELL, _ROW, _END = "\x01", "\x02", "\x03", "\x04"
_BLANK = " \t\r\n"
#: The widest cell, as in HTML.
MOST_COLUMNS = 1000


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _referenced(part: Column) -> Column:
    """A part of a text that followed ``&#``: its number as a character, then the rest. Control characters stay references."""

    def character(number: Column) -> Column:
        hexadecimal = F.lower(F.substring(number, 1, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).try_cast("int")
        rest = F.substring(part, F.length(number) + 2, F.length(part))
        return F.when(number != "", _once(code, lambda c: F.when(valid(c), F.concat(letter(c), rest))))

    valid = lambda code: (code > 8) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    number = F.regexp_extract(F.substring_index(part, ";", 1), r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})\z", 1)
    ended = F.when(part.contains(";"), number).otherwise("")
    return F.coalesce(_once(ended, character), F.concat(F.lit("&#"), part))


def decoded(text: Column) -> Column:
    """Numeric and the common named character references as their characters."""

    def characters(t: Column) -> Column:
        return _once(F.split(t, "&#"), lambda parts: F.concat(
            F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _referenced), "")
        ))

    def named(t: Column) -> Column:
        out = t
        for reference, letter in NAMED.items():
            out = F.replace(out, F.lit(reference), F.lit(letter))
        return F.when(t.contains("&"), out).otherwise(t)

    return _once(text, lambda t: F.when(t.contains("&"), _once(characters(t), named)).otherwise(t))


def inner_text(html: Column) -> Column:
    return F.trim(decoded(F.regexp_replace(html, TAG, " ")))


def header_lines() -> Column:
    """Blue and red result lines of a header page as one struct."""
    return F.struct(
        *[
            inner_text(F.regexp_extract("html", HEADER_LINE.format(side), 1)).alias(f"{side}_text")
            for side in ("blue", "red")
        ]
    )


def reject_reason() -> Column:
    """Why a game with these team and winner columns is left out; NULL for a good one."""
    unknown = (F.col("blue_team") == "Unknown") | (F.col("red_team") == "Unknown")
    return F.when(F.col("winning_team").isNull(), "no winner").when(unknown, "unknown team")


def parse_headers(headers: DataFrame) -> DataFrame:
    """Teams and winner per game, with the reason when the game has to be left out."""
    return headers.select(
        "game_id",
        team_from_header("blue_text").alias("blue_team"),
        team_from_header("red_text").alias("red_team"),
        winner_from_headers("blue_text", "red_text").alias("winning_team"),
    ).withColumn("reject", reject_reason())


def accepted_headers(headers: DataFrame) -> DataFrame:
    return parse_headers(headers).where(F.col("reject").isNull()).drop("reject")


def first_table(html: Column) -> Column:
    """The page from its first table tag to that table's own end, or to the page's end where it has none.

    The page is cut at table tags only, and one pass over these few pieces counts how deep each lies.
    Of tables inside the first only the text stays, as text of the cell that holds them.
    """
    pieces = F.split(F.regexp_extract(html, FROM_TABLE, 0), TABLE_TAG)
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("open"), F.lit("").alias("text"))

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(F.substring(piece, 1, 2) == "</", -1).otherwise(1)
        own = F.when(depth == 1, piece).otherwise(F.regexp_replace(piece, TAG, " "))
        going = at["open"] & (depth > 0)
        return F.struct(depth.alias("depth"), going.alias("open"), F.when(going, F.concat(at["text"], own)).otherwise(at["text"]).alias("text"))

    return F.aggregate(F.filter(pieces, lambda x: x != ""), start, step, lambda at: at["text"])


def _marked_table() -> Column:
    """First table of a stats page, its rows and cells marked, other tags taken out, references not yet decoded."""
    flat = first_table(F.col("html"))
    for pattern, mark in ((ROW, _ROW), (CELL, f"{_CELL}$1$2{_TEXT}"), (CELL_END, _END), (TAG, " ")):
        flat = F.regexp_replace(flat, pattern, mark)
    return flat


def _data_rows(flat: Column) -> Column:
    return F.filter(F.split(flat, _ROW), lambda r: r.contains(_CELL + "d") | r.contains(_CELL + "D"))


def _cells_of(row: Column) -> Column:
    return F.slice(F.split(row, _CELL), 2, F.lit(1 << 30))


def _columns_of(cell: Column) -> Column:
    """Columns that a cell takes: what its tag says, within bounds."""
    columns = F.coalesce(F.substring(F.substring_index(cell, _TEXT, 1), 2, 4).try_cast("int"), F.lit(1))
    return F.greatest(F.lit(1), F.least(columns, F.lit(MOST_COLUMNS)))


def _spans() -> Column:
    return F.lower("html").contains("colspan")


def stat_grid() -> Column:
    """First table of a stats page: array of rows, each an array of cell texts.

    Rows and cells begin at their tags, so missing end tags do no harm; what follows an end tag
    belongs to no cell. A cell of several columns is repeated. A row made of ``<th>`` cells only
    holds column labels, not data, and is left out. All passes run over the whole table, no pattern
    runs per cell.
    """
    every = F.lit(1 << 30)
    text = lambda body: F.trim(F.substring_index(body, _END, 1), F.lit(_BLANK))
    wide = lambda c: F.array_repeat(text(F.substring_index(c, _TEXT, -1)), _columns_of(c))
    plain = lambda data: F.transform(data, lambda r: F.transform(_cells_of(r), lambda c: text(F.substring(c, F.lit(3), every))))
    spanned = lambda data: F.transform(data, lambda r: F.flatten(F.transform(_cells_of(r), wide)))
    return _once(_data_rows(decoded(_marked_table())), lambda data: F.when(_spans(), spanned(data)).otherwise(plain(data)))


def page_players() -> Column:
    """`grid_players` of the page's `stat_grid`, from the marks alone: no text of a cell is decoded or kept."""
    plain = lambda data: F.transform(data, lambda r: F.size(F.split(r, _CELL)) - 1)
    spanned = lambda data: F.transform(
        data, lambda r: F.aggregate(F.transform(_cells_of(r), _columns_of), F.lit(0), lambda total, c: total + c)
    )
    widest = _once(_data_rows(_marked_table()), lambda data: F.array_max(F.when(_spans(), spanned(data)).otherwise(plain(data))))
    return F.when(F.col("html").isNotNull(), F.coalesce(widest, F.lit(1)) - 1)


def parsed_games(pages: DataFrame) -> DataFrame:
    """One row per game with its header lines and its stat grid.

    Pages are parsed where they are read; one aggregation brings the two kinds of a game together
    and leaves one of several stored copies, already on the map side.
    """
    kind = F.col("page_kind")
    parsed = pages.select(
        "game_id",
        F.when(kind == "header", header_lines()).alias("header"),
        F.when(kind == "stats", stat_grid()).alias("grid"),
    )
    return (
        parsed.groupBy("game_id")
        .agg(F.min("header").alias("header"), F.min("grid").alias("grid"))
        .select("game_id", "header.blue_text", "header.red_text", "grid")
    )


def grid_players(grid="grid") -> Column:
    """Number of player columns of a grid (its widest row without the stat name)."""
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(1)) - 1


def player_columns(
    grids: DataFrame, stats: dict[str, str] = PAGE_STATS, keep: list[str] | None = None
) -> DataFrame:
    """Transpose: one row per player column, one column per known stat (NULL where missing).

    ``stats`` maps canonical name to the stat name in the first column. The stat's grid row is
    looked up by name once per page; no pivot and no shuffle.
    """
    keep = keep or []
    names = F.transform("grid", lambda r: F.get(r, F.lit(0)))
    located = grids.select(
        "game_id",
        *keep,
        "grid",
        grid_players().alias("n_players"),
        *[F.array_position(names, s).cast("int").alias(f"__at_{c}") for c, s in stats.items()],
    ).where(F.col("n_players") > 0)
    exploded = located.withColumn("col_pos", F.explode(F.sequence(F.lit(1), F.col("n_players"))))
    return exploded.select(
        "game_id",
        *keep,
        (F.col("col_pos") - 1).alias("slot"),
        *[
            F.when(
                F.col(f"__at_{c}") > 0,
                F.get(F.get("grid", F.col(f"__at_{c}") - 1), F.col("col_pos")),
            ).alias(c)
            for c in stats
        ],
    )


def page_rejects(pages: DataFrame, players: int = PLAYERS_PER_GAME) -> DataFrame:
    """``game_id, reject`` of the games that `pages_to_player_games` leaves out, and why.

    Only numbers of players are gathered, no grids. Stored copies of a game's stats page that differ in their number
    are compared by their grids, and only those: the least grid counts, as everywhere.
    """
    kind = F.col("page_kind")
    width = F.when(kind == "stats", page_players())
    counted = pinned(
        pages.select("game_id", F.when(kind == "header", header_lines()).alias("header"), width.alias("width"))
        .groupBy("game_id")
        .agg(F.min("header").alias("header"), F.min("width").alias("n_players"), F.max("width").alias("most")),
        "pages",
    ).select("game_id", "header.blue_text", "header.red_text", "n_players", "most")
    unlike = pinned(counted.where(F.col("n_players") != F.col("most")).select(F.col("game_id").alias("unlike")), "unlike")
    if not unlike.isEmpty():
        same = F.col("game_id").eqNullSafe(F.col("unlike"))
        least = parsed_games(pages.join(unlike, same, "left_semi")).select(F.col("game_id").alias("unlike"), grid_players().alias("least"))
        counted = counted.join(least, same, "left").withColumn("n_players", F.coalesce("least", "n_players"))
    named = counted.select(
        "game_id",
        F.col("blue_text").isNull().alias("headless"),
        F.col("n_players").isNull().alias("statless"),
        "n_players",
        team_from_header("blue_text").alias("blue_team"),
        team_from_header("red_text").alias("red_team"),
        winner_from_headers("blue_text", "red_text").alias("winning_team"),
    )
    reason = (
        F.when(F.col("headless"), "no header page")
        .when(F.col("statless"), "no stats page")
        .when(F.col("n_players") != players, "wrong number of players")
        .otherwise(reject_reason())
    )
    return named.select("game_id", reason.alias("reject")).where(F.col("reject").isNotNull())


def typed_stats(df: DataFrame) -> DataFrame:
    """Page text to numbers; text that does not parse becomes NULL."""
    typed = {c: F.expr(f"try_cast(`{c}` AS int)") for c in INT_STATS if c in df.columns}
    typed |= {c: F.expr(f"try_cast(`{c}` AS double)") for c in DOUBLE_STATS if c in df.columns}
    return df.withColumns(typed)


def pages_to_player_games(
    pages: DataFrame,
    players: int = PLAYERS_PER_GAME,
    team_size: int = PLAYERS_PER_TEAM,
    stats: dict[str, str] = PAGE_STATS,
) -> DataFrame:
    """Player-game rows of all games with a winner, known teams and exactly ``players`` players."""
    games = parsed_games(pages).where(grid_players() == players)
    named = games.withColumns(
        {
            "blue_team": team_from_header("blue_text"),
            "red_team": team_from_header("red_text"),
            "winning_team": winner_from_headers("blue_text", "red_text"),
        }
    )
    accepted = named.where(reject_reason().isNull())
    teams = ["blue_team", "red_team", "winning_team"]
    return typed_stats(player_columns(accepted, stats, keep=teams)).withColumn(
        "win", win_by_slot("slot", team_size=team_size)
    )
