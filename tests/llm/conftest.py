from __future__ import annotations

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def docs_of(spark):
    """A documents table of the given (doc_id, text) pairs or full rows."""

    def make(rows):
        return spark.createDataFrame([(*r, "en", "src0", len(r[1] or "")) if len(r) == 2 else r for r in rows], DOCUMENTS)

    return make


@pytest.fixture
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
