"""Where intermediate tables live, and the sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` or set as the checkpoint folder.

    A missing setting is an error: a machine-local folder would not survive a lost executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured


def pinned(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once to the shared folder; later plans start from those files.

    Cuts the lineage without tying rows to executors, and gives the optimiser real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned_by(df: DataFrame, by: list[str], name: str = "step") -> DataFrame:
    """Like `pinned`, as a table bucketed by the columns `by`: grouping and joining on them needs no shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).option("path", path).saveAsTable(table)
    return spark.table(table)


def sized(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` pinned, and marked for broadcast only after its rows were counted against ``limit``.

    Above the limit it stays an ordinary join side.
    """
    small = pinned(df)
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that a glob pattern names, on any file system Spark reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return [f.getPath().toString() for f in found or []]


def fingerprint(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Number, bytes and digest of the files below the paths, by name, length and time of change.

    Spark lists the files and folds them into one row; no content is read. Folders and files whose
    names start with a dot or an underscore do not count. A path that is missing raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    row = files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(mark.cast("decimal(20,0)")), F.lit(0)).alias("total"), F.coalesce(F.bit_xor(mark), F.lit(0)).alias("mixed"),
    ).first()
    return {name: str(value) for name, value in row.asDict().items()}


def _manifest(spark: SparkSession, path: str) -> dict | None:
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    lines = spark.read.schema("value string").text(path).collect()  # one line
    return json.loads(lines[0].value) if lines else None


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def materialize(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: list[str] | None = None, settings: dict | None = None
) -> DataFrame:
    """Read the finished table at ``path``, or build, write and read it back.

    The commit marker is what counts: a folder left by a job that died half-way is rebuilt. With
    ``inputs`` (files and folders that ``build`` reads) or ``settings`` (JSON values), the table is
    used again only if a manifest beside it, ``<path>.manifest``, names the same files with the same
    lengths and times and the same settings; it also holds the schema, so that no footer is read.
    The manifest is emptied before a table is rebuilt and written after it: a run that dies between the
    two leaves a table that the next run rebuilds.
    """
    path = path.rstrip("/")
    done = path_exists(spark, f"{path}/_SUCCESS")
    if inputs is None and settings is None:
        if not done:
            build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    wanted = {"inputs": fingerprint(spark, inputs) if inputs else {}, "settings": json.loads(json.dumps(settings))}
    beside = f"{path}.manifest"
    held = _manifest(spark, beside) if done else None
    if held is None or {k: held.get(k) for k in wanted} != wanted:
        _write_manifest(spark, beside, {})
        table = build()
        table.write.mode("overwrite").parquet(path)
        held = {**wanted, "schema": spark.read.parquet(path).schema.jsonValue()}
        _write_manifest(spark, beside, held)
    return spark.read.schema(StructType.fromJson(held["schema"])).parquet(path)


def write_merged(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, *by: str, fmt: str = "parquet") -> None:
    """One folder per batch, per role or per role and model."""
    df.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)
