"""Newly landed batch files to feature rows, incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from matchlens.operators.features import engineer_features
from matchlens.schema import PLAYER_GAMES
from matchlens.sources.batches import canonical_columns, header_of, typed_columns


def read_landing(
    spark: SparkSession,
    landing: str,
    schema: T.StructType = PLAYER_GAMES,
    fmt: str = "parquet",
    max_files: int = 1000,
) -> DataFrame:
    """Stream of the files in ``landing``; ``max_files`` bounds one micro-batch, not the stream.

    Text files are read as text under the header of the files that are there when the stream
    starts; a later file with another header fails the stream instead of being misread.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if fmt != "csv":
        return reader.schema(schema).format(fmt).load(landing)
    header = header_of(spark, landing)
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = reader.schema(text).option("header", True).option("enforceSchema", False).csv(landing)
    return canonical_columns(rows)


def ingest(
    spark: SparkSession,
    landing: str,
    out: str,
    progress: str,
    schema: T.StructType = PLAYER_GAMES,
    fmt: str = "parquet",
    rejects: str | None = None,
) -> StreamingQuery:
    """Append the feature rows of all files not seen before, then stop.

    Only per-row features are derived, so the stream keeps no state. Series flags need the order
    of all games and stay a batch job. ``progress`` holds the stream's offsets and commits: a
    restart after a failure writes every file exactly once. Text rows that do not parse are left
    out of ``out``; a second stream collects them as text in ``rejects`` (default: beside ``out``).
    """
    landed = read_landing(spark, landing, schema, fmt)
    if fmt == "csv":
        landed, bad = typed_columns(landed, schema)
        _drain(bad, rejects or f"{out.rstrip('/')}-rejects", f"{progress}-rejects").awaitTermination()
    return _drain(engineer_features(landed), out, progress)


def _drain(rows: DataFrame, out: str, progress: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
