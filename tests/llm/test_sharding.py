from __future__ import annotations

from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from matchlens.llm.common import new_folder
from matchlens.llm.sharding import with_slots, write_shards


def check_law(rows, n, shards=8):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n and set(by) <= set(range(shards))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_whole_table_is_dealt_once_and_reproducibly(spark, small_docs):
    source = {r.doc_id: r.text for r in small_docs.collect()}
    folder = new_folder(spark, "t")
    got = write_shards(small_docs, folder, bucket_bytes=40_000).collect()
    assert {r.doc_id: r.text for r in got} == source
    check_law(got, len(source))
    again = with_slots(small_docs.repartition(5), bucket_bytes=40_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}
    other = with_slots(small_docs, bucket_bytes=40_000, seed=7).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in other} != {(r.doc_id, r.shard, r.slot) for r in got}
    order = [r.doc_id for r in sorted(got, key=lambda r: r.slot * 8 + r.shard)]
    assert order != sorted(order) and sum(abs(i - d) for i, d in enumerate(order)) > len(order) ** 2 / 5
    for part in Path(folder).glob("shard=*/*.parquet"):
        slots = pq.ParquetFile(part).read().column("slot").to_pylist()
        assert slots == sorted(slots)


def test_nulls_repeats_and_clashing_columns(spark, docs_of):
    rows = [(1, None), (1, None), (None, "x"), (None, None), (2, ""), (3, "long " * 50_000)] + [(9, "same")] * 40
    docs = docs_of(rows).withColumn("shard", F.lit("s")).withColumn("_bucket", F.lit(1)).withColumn("n", F.lit(2)).withColumn("start", F.lit(3)).withColumn("order", F.lit(4))
    for size in (10, 1 << 20):
        out = with_slots(docs, bucket_bytes=size)
        assert out.columns == [*docs.columns, "shard_", "slot"]
        got = out.drop("shard").withColumnRenamed("shard_", "shard").collect()
        check_law(got, len(rows))
        assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert with_slots(docs.limit(0)).count() == 0


def test_starts_do_not_depend_on_the_runs_of_buckets(spark, small_docs, monkeypatch):
    def slots():
        return {(r.doc_id, r.shard, r.slot) for r in with_slots(small_docs, bucket_bytes=10_000).collect()}

    whole = slots()
    for run, task in ((3, 1), (1, 64)):
        monkeypatch.setattr("matchlens.llm.sharding.RUN", run)
        monkeypatch.setattr("matchlens.llm.sharding.TASK", task)
        assert slots() == whole
