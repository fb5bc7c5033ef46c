"""Metric tables that come as files without a model column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions.text import canonical_header
from matchlens.schema import MODELS
from matchlens.sources.storage import matching_paths

# --- fixed values: metrics every such file must have ------------------------
REQUIRED = ["auc-roc", "log loss", "brier score", "accuracy", "f1-score"]
# ----------------------------------------------------------------------------


def named_by_row(df: DataFrame, row_no: str = "row_no", models: list[str] = MODELS) -> DataFrame:
    """Model names by file order: rows 0 to 3 of each role; further rows are left out.

    A role with fewer rows than models gets NULL in ``model``, so it cannot be misread.
    """
    firsts = df.where(F.col(row_no) < len(models))
    complete = (
        firsts.groupBy("role").agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= len(models))
    )
    names = F.array(*[F.lit(m) for m in models])
    return (
        firsts.join(complete, "role", "left")
        .withColumn("model", F.when(F.col("__n").isNotNull(), F.get(names, F.col(row_no))))
        .drop("__n")
    )


def check_complete(named: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """Raise when a role has fewer rows than models."""
    short = [r.role for r in named.where(F.col("model").isNull()).select("role").distinct().take(5)]
    if short:
        raise ValueError(f"expected at least {len(models)} rows for {short}")
    return named


def read_metric_files(spark: SparkSession, folder: str) -> DataFrame:
    """``role, row_no`` and the metrics of every ``metrics_<Role>.csv`` in a folder.

    The files hold metric columns only: the role is in the file name, the model in the row number.
    Columns are matched by name in each file, headers normalised; a metric that a file lacks is an
    error when it is required and NULL otherwise. Numbers that do not parse are NULL.
    """
    paths = matching_paths(spark, f"{folder.rstrip('/')}/metrics_*.csv")
    texts = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"metrics_([^/]*)\.csv", 1).alias("role"),
        F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"),
    )
    texts = texts.where(F.size("lines") > 0)  # empty part files of a folder that stands for a file
    headed = texts.withColumn("header", F.split(F.get("lines", F.lit(0)), ","))
    headers = {tuple(canonical_header(c.strip()) for c in r.header) for r in headed.select("header").distinct().collect()}
    for header in headers:
        if missing := [c for c in REQUIRED if c not in header]:
            raise KeyError(f"missing metric columns {missing}; columns seen: {list(header)}")
    known = sorted({c for header in headers for c in header})
    spelled = F.create_map(
        *[F.lit(v) for r in headed.select(F.explode("header").alias("c")).distinct().collect() for v in (r.c, canonical_header(r.c.strip()))]
    )
    rows = headed.select(
        "role",
        F.transform("header", lambda c: F.try_element_at(spelled, c)).alias("header"),
        F.posexplode(F.expr("slice(lines, 2, size(lines))")).alias("row_no", "line"),
    ).withColumn("cells", F.split("line", ","))
    return rows.select(
        "role",
        "row_no",
        *[F.get("cells", F.array_position("header", c).cast("int") - 1).try_cast("double").alias(c) for c in known],
    )
