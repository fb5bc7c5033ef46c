from __future__ import annotations

import base64
import gzip
import hashlib
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from check import compare
from matchlens.llm.common import new_folder, stored
from matchlens.llm.queries import ORACLES, QUERIES
from matchlens.llm.warc import Inflated, archive, normalise, record, records, revisits, write_monolithic


def test_query_against_sql(spark, con):
    assert compare(QUERIES["op1_warc_normalise"](spark, "/root/testdata/sf0.001"), con, ORACLES["op1_warc_normalise"]) is None


def test_members_can_be_read_alone(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else "page %d " % i * 500) for i in range(40)]
    listed = stored(write_monolithic(spark.createDataFrame(rows, "page_id long, url string, html string"), new_folder(spark, "t")), "listed")
    whole = [Path(r.file.removeprefix("file://")) for r in listed.select("file").distinct().collect()]
    assert all(f.read_bytes().count(b"\x1f\x8b\x08") == 1 for f in whole)
    index = normalise(listed, new_folder(spark, "m"), revisits(listed)).collect()
    assert len(index) == 40 and sum(r.record_type == "revisit" for r in index) == 25
    for r in index:
        path = Path(r.file.removeprefix("file://"))
        member = gzip.decompress(path.read_bytes()[r.offset : r.offset + r.length])
        [(headers, body)] = list(records(io.BytesIO(gzip.compress(member))))
        text = rows[int(r.id)][2]
        assert headers["x-page-id"] == r.id and headers["content-length"] == str(len(body))
        assert body.decode() == ("" if r.record_type == "revisit" else text)
        assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        line = Path(str(path) + ".idx").read_text().splitlines()[r.seq].split()
        assert [int(line[0]), int(line[1]), line[2], line[3]] == [r.offset, r.length, r.record_type, r.id]


def test_nulls_repeats_and_least_bytes(spark):
    rows = [(5, "u", None), (3, "v\r\nX: y", ""), (7, None, "é" * 9), (2, "w", "é" * 9), (2, "w", "é" * 9), (None, "n", "é" * 9), (9, "l", "WARC/1.1\r\n\r\n" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("seq", F.lit("s"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive(spark, pages).collect()), key=str)
    want = [("5", 0, "revisit", "3"), ("3", 0, "response", None), ("7", 18, "revisit", "2"), ("2", 18, "response", None), ("2", 18, "response", None), (None, 18, "response", None), ("9", 2_400_000, "response", None)]
    assert got == sorted(want, key=str)
    kinds = {r.page_id: r.record_type for r in archive(spark, pages, least_bytes=10).collect()}
    assert kinds["5"] == "response" and kinds["7"] == "revisit"
    assert archive(spark, pages.limit(0)).count() == 0


def test_broken_streams_are_errors():
    plain = record("response", "u", "1", "X", 3, b"abc")
    whole = gzip.compress(plain)
    assert [b for _, b in records(io.BytesIO(whole + whole))] == [b"abc", b"abc"]
    for broken in (whole[:-12], gzip.compress(plain[:40]), gzip.compress(b"hello\r\n")):
        with pytest.raises(ValueError):
            list(records(io.BytesIO(broken)))
    assert Inflated(io.BytesIO(b"")).line() is None


def test_a_task_for_every_archive(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(60)], "page_id long, url string, html string").repartition(6)
    listed = stored(write_monolithic(pages, new_folder(spark, "w")), "listed")
    n = listed.select("file").distinct().count()
    out = normalise(listed, new_folder(spark, "m"), revisits(listed))
    assert out.rdd.getNumPartitions() == n > 1 and out.count() == 60
