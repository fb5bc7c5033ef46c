"""Player-game files: base file plus numbered batches, read by column name under an explicit schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlens.operators.joins import salted_join
from matchlens.schema import PLAYER_GAMES, PLAYERS_PER_GAME, PRESSURE_INPUT, RENAMES
from matchlens.sources.storage import matching_paths

BASE_FILE = "all_matches.csv"
BATCH_FILE = "all_matches_batch_{}.csv"
#: Column with the file a row came from.
LINEAGE = "batch_file"


def canonical_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[RENAMES.get(c, c) for c in df.columns])


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a file's first line; nothing else is read."""
    return tuple(spark.read.option("header", True).option("inferSchema", False).csv(path).columns)


def file_name(path: Column) -> Column:
    """The last part of a path, or the folder that holds it, that ends in ``.csv``: the folder goes first."""
    last, folder = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.when(folder.endswith(".csv"), folder).when(last.endswith(".csv"), last).otherwise("")


def read_text_columns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as text under canonical names, matched by name, with the file in ``batch_file``.

    Files with the same header share a scan; a column that a file lacks is NULL there.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(header_of(spark, path), []).append(path)
    parts = []
    for header, files in by_header.items():
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        scan = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(files)
        parts.append(canonical_columns(scan).withColumn(LINEAGE, file_name(F.col("_metadata.file_path"))))
    return union_batches(parts)


def typed_columns(text: DataFrame, schema: T.StructType = PLAYER_GAMES) -> tuple[DataFrame, DataFrame]:
    """Rows cast to the types of ``schema``, and the rows of which a number does not parse (as text).

    Integers are read through doubles, because writers with missing values turn ``3`` into ``3.0``;
    a fraction in an integer column does not parse. Empty and NaN texts are missing values. Columns
    of the schema that no file has are NULL; columns it does not name stay text.
    """
    wanted: dict[T.DataType, list[str]] = {}
    for f in schema.fields:
        if f.name in text.columns and not isinstance(f.dataType, T.StringType):
            wanted.setdefault(f.dataType, []).append(f.name)
    # generated rows, one per row: what is above them reads the cells and does not parse again
    types, rows = list(wanted), F.lit(True).alias("row")
    named = F.struct(*[_texts(wanted[t]).alias(f"t{i}") for i, t in enumerate(types)], rows)
    values = F.struct(*[_values(F.col(f"__texts.t{i}"), t).alias(f"t{i}") for i, t in enumerate(types)], rows)
    parsed = text.select("*", F.explode(F.array(named)).alias("__texts")).select("*", F.explode(F.array(values)).alias("__values"))
    present = lambda cells: F.size(F.filter(cells, lambda cell: cell.isNotNull()))
    faults = [present(F.col(f"__texts.t{i}")) > present(F.col(f"__values.t{i}")) for i in range(len(types))]
    marked = parsed.withColumn("__bad", reduce(lambda a, b: a | b, faults, F.lit(False)))
    casts = {c: F.col(f"__values.t{i}")[n] for i, t in enumerate(types) for n, c in enumerate(wanted[t])}
    casts |= {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in text.columns}
    rest = [c for c in text.columns if c not in schema.fieldNames()]
    clean = marked.where(~F.col("__bad")).withColumns(casts).select(*schema.fieldNames(), *[f"`{c}`" for c in rest])
    return clean, marked.where("__bad").drop("__texts", "__values", "__bad")


def _texts(columns: list[str]) -> Column:
    """The cells of some columns as an array, missing ones NULL.

    Steps over arrays: written out for every column they make a method of code too long to be compiled.
    """
    return F.transform(F.array(*[F.trim(f"`{c}`") for c in columns]), lambda raw: F.when(~F.lower(raw).isin("", "nan"), raw))


def _values(texts: Column, kind: T.DataType) -> Column:
    """The values of `texts`, NULL where a text is none of this type."""
    numbers = texts.try_cast("array<double>")
    if isinstance(kind, T.DoubleType):
        return numbers
    if isinstance(kind, T.BooleanType):
        return F.transform(texts, lambda raw: F.coalesce(raw.try_cast("boolean"), raw.try_cast("double") != 0))
    return F.transform(numbers, lambda number: F.when(number == F.floor(number), number.try_cast(kind)))


def existing_batches(spark: SparkSession, base: str) -> list[str]:
    """The base file and all numbered batches that are there, whatever their number."""
    found = matching_paths(spark, f"{base.rstrip('/')}/{BATCH_FILE.format('*')}")
    first = matching_paths(spark, f"{base.rstrip('/')}/{BASE_FILE}")
    if not first:
        raise FileNotFoundError(f"no {BASE_FILE} in {base}")
    return [*first, *sorted(found)]


def load_batches_checked(
    spark: SparkSession, base: str, schema: T.StructType = PLAYER_GAMES
) -> tuple[DataFrame, DataFrame]:
    """All files of a folder as typed rows, and the rows that do not parse, both with their file."""
    return typed_columns(read_text_columns(spark, existing_batches(spark, base)), schema)


def load_batches(spark: SparkSession, base: str, schema: T.StructType = PLAYER_GAMES) -> DataFrame:
    """The typed rows of all files with their lineage. A missing base file is an error. Overlapping
    batches stay as they are (see ``drop_copies``)."""
    return load_batches_checked(spark, base, schema)[0]


def read_pressure_input(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pressure-analysis rows as they are stored (``"True"``, ``final_games``), and rows that do not parse."""
    return typed_columns(read_text_columns(spark, paths), PRESSURE_INPUT)


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Union by column name; a column that a batch lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def drop_copies(df: DataFrame, keys: list[str], lineage: str = LINEAGE) -> DataFrame:
    """One row per key: the copy with the most values, of equally full ones the base file's, then by
    file name and content. All but one copy per key and task are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    filled = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNotNull().cast("int") for c in rest], F.lit(0))
    by_file = [F.desc(F.col(lineage) == BASE_FILE), F.col(lineage)] if lineage in df.columns else []
    order = W.partitionBy(*keys).orderBy(F.desc(filled), *by_file, *[F.col(f"`{c}`") for c in rest])
    return df.withColumn("__copy", F.row_number().over(order)).where("__copy = 1").drop("__copy")


def valid_games(
    player_games: DataFrame, players: int = PLAYERS_PER_GAME, spread: list[str] | None = None
) -> DataFrame:
    """Rows of games with exactly ``players`` rows."""
    ok = player_games.groupBy("game_id").count().where(F.col("count") == players)
    return salted_join(player_games, ok.select("game_id"), ["game_id"], "left_semi", spread=spread)


def rejected_games(player_games: DataFrame, players: int = PLAYERS_PER_GAME) -> DataFrame:
    """The other games with their row counts, for a side output."""
    return (
        player_games.groupBy("game_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") != players)
    )


def split_dirty(df: DataFrame, numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose text columns all parse as numbers (cast), and the rows that do not (as text)."""
    parsed = [F.expr(f"try_cast(`{c}` AS double)") for c in numeric]
    bad = reduce(
        lambda a, b: a | b,
        [F.col(c).isNotNull() & p.isNull() for c, p in zip(numeric, parsed, strict=True)],
    )
    marked = df.withColumn("__bad", bad)
    clean = marked.where(~F.col("__bad")).drop("__bad")
    return (
        clean.withColumns(dict(zip(numeric, parsed, strict=True))),
        marked.where("__bad").drop("__bad"),
    )
