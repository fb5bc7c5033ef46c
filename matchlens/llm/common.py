"""Helpers shared by the text operators: stored tables, hot-key lookups, Arrow row mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlens.sources.storage import shared_dir

#: Parts into which the rows of one key are dealt by `lookup` and `salt`.
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the session's checkpoint folder; without either it raises."""
    return shared_dir(spark).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives executors."""
    path = new_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until `df` has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salt(*cols: str | Column, n: int = SALTS) -> Column:
    """A part number fixed by the row's content, so that a repeated task deals alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def lookup(left: DataFrame, right: DataFrame, key: str, spread: list[str], n: int = SALTS) -> DataFrame:
    """Left join to `right`, which has one row for each `key`, when a key may hold most of `left`.

    Rows of a key are dealt into `n` parts by a hash of the columns `spread`. Only the (key, part)
    pairs that occur meet `right`, at most `n` for a key, and then meet the rows part by part.
    A null key finds nothing and its row stays.
    """
    part = fresh(left, "_part")
    dealt = left.withColumn(part, salt(*[F.col(c) for c in spread], n=n))
    pairs = dealt.select(key, part).where(F.col(key).isNotNull()).distinct()
    return dealt.join(pairs.join(right, key), [key, part], "left").drop(part)


def map_rows(
    df: DataFrame, column: str, make: Callable[[], Callable[[list], dict[str, pa.Array]]], added: T.StructType,
    binary: bool = False, rows: int = 512,
) -> DataFrame:
    """`df` with the columns `added`, computed from `column` by Arrow batches; no row moves.

    `make` is called once per task and gives a function from a list of values (nulls as None) to the
    arrays of the added columns. Batches are cut to `rows` rows, so that a task holds few texts.
    """
    schema = T.StructType(df.schema.fields + added.fields)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                values = batch.column(at)
                if binary:
                    values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
                out = work(values.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    batch.columns + [out[f.name] for f in added.fields], [*batch.schema.names, *[f.name for f in added.fields]]
                )

    return df.mapInArrow(run, schema)
