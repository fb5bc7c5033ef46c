"""Sharding by a two-pass external shuffle.

Pass one scatters records into buckets of a bounded size by a seeded hash of their content. Pass two
puts the records of each bucket into a Fisher-Yates order and deals the resulting sequence of all
buckets to the shards in turn. Records are sorted and moved by Spark; only the permutation of a
bucket, a list of its row numbers, is held as one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import fresh, new_folder, stored

SHARDS, SEED = 8, 42
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Parts in which permutations are drawn; fixed, so that a seed gives one order on any cluster.
DRAWS = 256
#: Buckets whose starts are summed up in one window, and buckets in one task of the row shuffle.
RUN, TASK = 4096, 8


def with_slots(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs` with ``shard`` and ``slot``: a random order of all rows, dealt to the shards in turn.

    Shard sizes in rows differ by one at most and slots are gapless from 0. The order depends on the
    content of the rows, the seed and the bucket size. Null ids and texts and repeated rows are
    records like others; equal rows share a bucket, which is sorted on disk when it is large.
    Columns of `docs` named shard or slot get the results under lengthened names.
    """
    bucket, rank, of, start, order, shard, slot = (
        fresh(docs, n) for n in ("_bucket", "_rank", "_of", "_start", "_order", "shard", "slot")
    )
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 0
    n_buckets = -(-total // bucket_bytes) or 1
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    scattered = docs.withColumn(bucket, F.pmod(place, F.lit(n_buckets)))
    counts = stored(scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), "buckets")
    runs = counts.withColumn("run", F.floor(F.col(bucket) / RUN))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row per run of buckets, total / (RUN * bucket_bytes) rows: 32 GB of text each
    offsets = runs.groupBy("run").agg(F.sum("n").alias("all")).select(
        "run", F.coalesce(F.sum("all").over(before.orderBy("run")), F.lit(0)).alias("offset")
    )
    inner = F.coalesce(F.sum("n").over(before.partitionBy("run").orderBy(bucket)), F.lit(0))
    starts = runs.withColumn("inner", inner).join(offsets, "run").withColumn(start, F.col("offset") + F.col("inner"))
    drawn = (
        starts.repartition(DRAWS, bucket)
        .sortWithinPartitions(bucket)
        .select(F.col(bucket).alias(of), start, F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), seed).alias(order))
    )
    drawn = stored(drawn, "orders")
    inside = Window.partitionBy(bucket).orderBy(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text)), id_col)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_buckets // TASK))
    ranked = scattered.repartition(tasks, bucket).withColumn(rank, F.row_number().over(inside))
    at = F.col(start) + F.element_at(order, F.col(rank))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return ranked.join(drawn.hint("merge"), F.col(bucket) == F.col(of)).select(
        *names, F.pmod(at, F.lit(shards)).cast("int").alias(shard), F.floor(at / shards).cast("long").alias(slot)
    )


def write_shards(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Write `docs` with its slots as one folder per shard, each file in slot order; returns what was written."""
    folder = folder or new_folder(docs.sparkSession, "shards")
    placed = with_slots(docs, **settings)
    shard, slot = placed.columns[-2:]
    placed.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)
    return docs.sparkSession.read.schema(placed.schema).parquet(folder)
