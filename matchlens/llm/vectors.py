"""Near-duplicate vectors by random-hyperplane sign hashing.

Copies of a vector are one class. Every class has, in each of several tables, the signs of its
products with random hyperplanes as a key. Classes of one key meet as blocks of bounded size and
their exact cosines are taken as matrix products in double precision. A pair counts in the first
table in which its keys agree, so no pair is counted twice and none has to leave its block: a block
gives each class its number of new links and one tie that keeps linked classes connected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import lookup, stored
from matchlens.llm.components import components

COSINE, MISS, SEED = 0.95, 0.001, 42
#: Classes that a block holds on average; keys of more classes are cut into parts that meet pairwise.
BLOCK = 1024
#: Crowded keys up to this number go to every task (they are counted); more are met by a shuffled lookup.
FEW = 100_000
#: Linked pairs whose keys are compared at a time.
PAIRS = 1 << 17


def key_bits(classes: int, block: int = BLOCK) -> int:
    """Signs of a key: so many that unrelated classes of one key fill a block."""
    return min(30, max(4, math.ceil(math.log2(max(1, classes) / block)))) if classes > block else 4


def table_count(bits: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Tables by which a pair at exactly `cosine` agrees in one key at least, but for the chance `miss`."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def planes(dims: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, tables * bits))


def _even(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two to components of at most 1, which changes no cosine."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))
    return np.ldexp(x, -exponent)


def _prepared(rows: DataFrame) -> DataFrame:
    """(id, class, dims, v): v is the vector as doubles in bytes; null class where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, dims, vectors = [], [], []
            for value in batch.column("v"):
                flat = value.values if value.is_valid else None
                good = flat is not None and len(flat) and not flat.null_count
                x = flat.to_numpy(zero_copy_only=False) + 0.0 if good else None  # -0.0 becomes 0.0
                good = good and np.isfinite(x).all() and x.any()
                names.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if good else None)
                dims.append(len(x) if good else None)
                vectors.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())],
                ["id", "class", "dims", "v"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, class string, dims int, v binary")


def _keyed(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """`classes` with ``keys``, the key of every table as four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            dims, vectors, keys = batch.column("dims").to_pylist(), batch.column("v").to_pylist(), [b""] * batch.num_rows
            for d in set(dims):
                if d not in known:
                    known[d] = planes(d, tables, bits, seed)
                at = [i for i, other in enumerate(dims) if other == d]
                x = _even(np.frombuffer(b"".join(vectors[i] for i in at)).reshape(-1, d))
                own = ((x @ known[d] > 0).reshape(len(at), tables, bits) @ weights).astype(np.uint32)
                for i, row in zip(at, own, strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "keys"])

    return classes.mapInArrow(run, f"class string, dims int, v binary, copies long, least {classes.schema['least'].dataType.simpleString()}, keys binary")


def _new_links(a: dict, b: dict, table: int, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of this cosine at least whose keys agree in no table before `table`."""
    s = a["x"] @ b["x"].T
    s /= a["norm"][:, None]
    s /= b["norm"][None, :]
    i, j = np.nonzero(s >= cosine)
    if same:
        i, j = i[i < j], j[i < j]
    fresh = np.ones(len(i), bool)
    for at in range(0, len(i) if table else 0, PAIRS):
        part = slice(at, at + PAIRS)
        fresh[part] = ~(a["keys"][i[part], :table] == b["keys"][j[part], :table]).any(axis=1)
    return i[fresh], j[fresh]


def _rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of `n` rows reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _block_links(postings: DataFrame, tables: int, cosine: float) -> DataFrame:
    """(class, n_new, tie) of every class with new links in a block; `tie` is a class that it reaches there."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        table, low, high = key[1].as_py(), key[2].as_py(), key[3].as_py()
        rows = rows.sort_by("class")
        names, copies = rows.column("class").to_pylist(), rows.column("copies").to_numpy()
        x = _even(np.frombuffer(b"".join(rows.column("v").to_pylist())).reshape(len(names), -1))
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint32).reshape(len(names), tables)
        sides, norm, part = [], np.sqrt((x * x).sum(axis=1)), rows.column("part").to_numpy()
        for p in (low, high):
            at = np.nonzero(part == p)[0]
            sides.append({"at": at, "x": x[at], "norm": norm[at], "keys": keys[at]})
        a, b = sides
        i, j = _new_links(a, b, table, low == high, cosine)
        i, j = a["at"][i], b["at"][j]
        linked = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
        root, at = _rooted(len(names), i, j), np.nonzero(linked)[0]
        return pa.table({
            "class": pa.array([names[k] for k in at], pa.string()), "n_new": pa.array(linked[at].astype(np.int64)),
            "tie": pa.array([names[root[k]] for k in at], pa.string()),
        })

    return postings.groupBy("bucket", "table", "low", "high").applyInArrow(work, "class string, n_new long, tie string")


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, miss: float = MISS, block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `rows`: the id, ``n_links`` (other rows linked directly), ``component_id`` and ``kept``.

    Rows link at this cosine or more, in double precision. Of the pairs at exactly this cosine a
    share of `miss` is expected to be overlooked, of closer ones fewer, at every size of the table;
    no pair below it links. Copies always link. Vectors that are null, empty or zero or hold null or
    non-finite components link with nothing, and vectors of different lengths do not link.
    ``component_id`` is the smallest id reachable; a row with a null id takes part but names no
    component, a component without any id has a null one. ``kept`` says whether the row's id is its
    component's, so repeated rows of one id are all kept or none. Other columns and their names play
    no part. An empty table gives an empty one.
    """
    base = stored(_prepared(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))), "vectors")
    whole = base.where("class is not null").groupBy("class", "dims", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = stored(whole.select("class", "dims", "v", "copies", "least"), "classes")
    bits = key_bits(classes.count(), block)
    tables = table_count(bits, cosine, miss)
    keyed = stored(_keyed(classes, tables, bits, seed), "keyed")

    hexes = F.hex("keys")  # four bytes, lowest first, are eight digits
    own = [F.struct(F.lit(t).alias("table"), F.substring(hexes, 8 * t + 1, 8).alias("key")) for t in range(tables)]
    bucket = F.concat_ws("/", "dims", "table", "key")
    listed = keyed.select("class", "dims", F.inline(F.array(*own))).select("class", "table", bucket.alias("bucket"))
    crowded = stored(
        listed.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("parts")),
        "crowded",
    )
    postings = keyed.select("class", "dims", "v", "copies", "keys", F.inline(F.array(*own))).select(
        "class", "v", "copies", "keys", "table", bucket.alias("bucket")
    )
    few = crowded.count() <= FEW
    parted = postings.join(F.broadcast(crowded), "bucket", "left") if few else lookup(postings, crowded, "bucket", ["class"])
    parted = parted.withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = parted.select("*", others.alias("other")).select(
        "class", "v", "copies", "keys", "table", "bucket", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    found = stored(_block_links(met, tables, cosine), "links")

    counts = found.groupBy("class").agg(F.sum("n_new").alias("n_new"))
    roots = components(found.select(F.col("class").alias("a"), F.col("tie").alias("b")))
    rooted = classes.select("class", "copies", "least").join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "class")).join(counts, "class", "left"), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = stored(lookup(rooted, smallest, "root", ["class"]).select(
        "class", (F.coalesce("n_new", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    ), "groups")
    placed = lookup(base.select("id", "class"), of_class, "class", ["id"])
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return placed.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
