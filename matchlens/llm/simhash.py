"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints at 3 or fewer differing bits have a
segment in which they differ in one bit or none, so every fingerprint looks up the Hamming ball of
radius 1 around each of its segments and verifies the complete distance of what it finds. Only
distinct fingerprints take part; documents find their group through their fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlens.llm.common import fresh, lookup, map_rows, stored
from matchlens.llm.components import components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: A table slot with more fingerprints than this is split by the other segment (`links`).
CROWDED = 256


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of whole UTF-8 text; null, empty and blank texts have 0."""
    found = (text or b"").lower().split()  # for bytes: A-Z only, and the six ASCII blanks only
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, last, 65536):
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), seed) for i in range(start, min(last, start + 65536))),
            np.uint64,
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words: int = SHINGLE_WORDS) -> DataFrame:
    """`docs` with the fingerprint of each whole text as the long column `out`; no row moves."""

    def make():
        return lambda texts: {out: pa.array([fingerprint(t, words) for t in texts], pa.int64())}

    return map_rows(docs, text, make, T.StructType([T.StructField(out, T.LongType())]), binary=True)


def _halves(fp: Column) -> Column:
    """(segment number, its 32 bits, the other 32 bits) for both segments."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(0xFFFFFFFF)
    return F.array(*[F.struct(F.lit(i).alias("seg"), a.alias("own"), b.alias("other")) for i, (a, b) in enumerate([(high, low), (low, high)])])


def _ball(value: Column, bits: int) -> Column:
    """`value` and its neighbours with one more bit set; those with one bit less look up `value`."""
    flips = [F.when(value.bitwiseAND(1 << b) == 0, value.bitwiseOR(F.lit(1 << b))) for b in range(bits)]
    return F.array_compact(F.array(value, *flips))


def _quarters(value: Column, balls: bool) -> Column:
    """(half number, its 16 bits) of a segment; with `balls` every neighbour at one bit as well."""
    parts = [F.shiftrightunsigned(value, 16), value.bitwiseAND(0xFFFF)]
    flips = [0, *[1 << b for b in range(16)]] if balls else [0]
    return F.array(*[
        F.struct(F.lit(i).alias("sub"), part.bitwiseXOR(F.lit(flip)).alias("subslot")) for i, part in enumerate(parts) for flip in flips
    ])


def links(distinct: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of the distinct longs `fp` at `max_bits` or fewer differing bits, each pair once or twice.

    `max_bits` is at most 3, the reach of two segments with radius 1. A slot of the table that more
    than `crowded` fingerprints share is not compared within itself: its members are told apart by
    the same lookup on the halves of their other segment (two bits apart or less on one side of it
    means one bit or none in one of its halves), so no slot is compared as a whole. The exploded
    sides are never broadcast: the optimiser takes them for as small as what they are made from.
    """
    if max_bits > 3:
        raise ValueError("two segments with radius 1 reach three differing bits")
    rows = distinct.select("fp", F.inline(_halves(F.col("fp"))))
    table = rows.select("seg", F.col("own").alias("slot"), "fp", "other")
    probes = rows.select("seg", "fp", "other", "own", F.explode(_ball(F.col("own"), 32)).alias("slot"))
    full = table.groupBy("seg", "slot").count().where(F.col("count") > crowded).select("seg", "slot", F.lit(True).alias("full"))
    marked_table = stored(table.join(full, ["seg", "slot"], "left").withColumn("full", F.coalesce("full", F.lit(False))), "slots")
    crowded_slots = stored(marked_table.where("full").select("seg", "slot").distinct(), "crowded")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= max_bits
    # a pair that shares the slot outright is found from its smaller member
    once = (F.col("p.own") != F.col("p.slot")) | (F.col("p.fp") < F.col("t.fp"))
    plain = (
        probes.alias("p")
        .hint("merge")
        .join(marked_table.where("not full").alias("t"), ["seg", "slot"])
        .where(near & once)
        .select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    )

    inner = marked_table.where("full").select("seg", "slot", "fp", F.inline(_quarters(F.col("other"), False)))
    outer = probes.join(crowded_slots, ["seg", "slot"], "left_semi").select(
        "seg", "slot", "fp", "own", F.inline(_quarters(F.col("other"), True))
    )
    split = (
        outer.alias("p")
        .hint("merge")
        .join(inner.alias("t"), ["seg", "slot", "sub", "subslot"])
        .where(near & once)
        .select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    )
    return plain.union(split)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, words: int = SHINGLE_WORDS,
    crowded: int = CROWDED,
) -> DataFrame:
    """One row per row of `docs`: the id, ``fp`` (long) and ``component_id``, the smallest id reachable.

    Null and blank texts have fingerprint 0 and link like any other. Rows of equal text, repeated
    rows included, share a fingerprint and so a component. A row whose id is null takes part but
    names no component; a component without any id has a null one. Other columns of `docs`, and
    their names, play no part. An empty table gives an empty one.
    """
    return _grouped(docs, id_col, text, max_bits, words, crowded).select(F.col("id").alias(id_col), "fp", "component_id")


def _mark(text: str) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.col(text))


def _grouped(docs: DataFrame, id_col: str, text: str, max_bits: int, words: int, crowded: int) -> DataFrame:
    """(id, mark, fp, root, component_id) per row; the root is the smallest fingerprint of the component."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    prints = stored(fingerprints(base, "text", "fp", words).select("id", _mark("text").alias("mark"), "fp"), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits, crowded))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = stored(lookup(rooted.select("fp", "root"), smallest, "root", ["fp"]).select("fp", "root", "component_id"), "groups")
    return lookup(prints, of_print, "fp", ["id"]).select("id", "mark", "fp", "root", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, words: int = SHINGLE_WORDS, crowded: int = CROWDED
) -> DataFrame:
    """`docs` with one document of each near-duplicate group, the one of the smallest id.

    Rows of that id in the group leave the one of the smallest text, null first; of equal ones any.
    Rows of one id in different groups are kept or not each by their own group. Rows with a null id
    cannot be named and stay. Columns and their types stay as they are.
    """
    found = _grouped(docs, id_col, text, max_bits, words, crowded).where(F.col("id") == F.col("component_id"))
    kept_id, mark, root, rank = (fresh(docs, n) for n in ("_id", "_mark", "_root", "_rank"))
    keep = stored(found.select(F.col("id").alias(kept_id), F.col("mark").alias(mark), F.col("root").alias(root)).distinct(), "kept")
    firsts = (
        docs.join(keep, (F.col(id_col) == F.col(kept_id)) & (_mark(text) == F.col(mark)))
        .withColumn(rank, F.row_number().over(Window.partitionBy(id_col, root).orderBy(F.col(text).asc_nulls_first())))
        .where(F.col(rank) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
    return firsts.unionByName(docs.where(F.col(id_col).isNull()))
