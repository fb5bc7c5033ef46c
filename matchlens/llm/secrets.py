"""Secret scans, told apart by how many owners hold a value.

Every whole text is scanned once for candidate values. Their hashes are counted over the corpus by
distinct repositories and owners: a value that many owners hold is a copied example, one that few
hold and that looks random is a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import fresh, lookup, stored

#: Base kinds in order, their patterns and least lengths: fixed values of the contract.
BASE = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: What the base kinds leave out; a candidate counts only where no base span overlaps it and it is live.
WIDE = {
    "upper": (re.compile(r"(?a)\b[0-9A-F]{24,}\b"), 0, 24),
    "mixed": (re.compile(r"(?a)(?<![\w+/=-])(?=[\w+/=-]*[a-z])(?=[\w+/=-]*[A-Z])(?=[\w+/=-]*[0-9])[\w+/=-]{20,}"), 0, 20),
}
KINDS = [*BASE, *WIDE]
#: From so many distinct owners on a value is a copied example.
EXAMPLE_OWNERS = 5
#: Bits per character, and distinct characters, that a live-looking value has at least.
LIVE_BITS, LIVE_LETTERS = 2.5, 8
#: Runs of fewer hex characters than a candidate needs are skipped without a match object each.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

SPAN = "struct<kind:string,start:int,end:int,hash:string,looks_live:boolean>"


def looks_live(value: str) -> bool:
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return len(counts) >= LIVE_LETTERS and bits >= LIVE_BITS


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of base and wide candidates, by start, then kind as listed.

    Matches are leftmost and do not overlap within a kind; those below the least length are dropped
    after matching. Positions count code points, the end is exclusive.
    """
    if not text:
        return []
    found = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "hex":
            pattern = _LONG_HEX  # a longest run of 24 or more: the runs that the base pattern keeps
        found += [(kind, m.start(), m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    starts, ends = [], []  # the stretches that base spans cover
    for _, start, end, _ in sorted(found, key=lambda s: s[1]):
        if starts and start <= ends[-1]:
            ends[-1] = max(end, ends[-1])
        else:
            starts.append(start)
            ends.append(end)
    for kind, (pattern, group, _) in WIDE.items():
        for m in pattern.finditer(text):
            at = bisect_right(ends, m.start())
            if at == len(starts) or starts[at] >= m.end():
                found.append((kind, m.start(), m.end(), m[group]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """`docs` with an array `out` of its candidates; values are kept as hashes only."""
    at, names = docs.columns.index(text), [*docs.columns, out]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("looks_live", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                spans = [
                    [
                        {"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest(), "looks_live": looks_live(v)}
                        for k, a, b, v in scan(value)
                    ]
                    for value in batch.column(at).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names)

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{out}` array<{SPAN}>"]))


def ownership(values: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of the values (hash, repo, owner): distinct, over the whole corpus.

    Owners and repositories are made distinct before a value's rows meet, so a value that a third of
    all rows hold costs as many rows as it has repositories. Null owners and repositories count as one.
    """
    places = values.select("hash", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    by_owner = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def judged(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(row, spans) for a stored table (row, repo, owner, spans) of candidates: every span with its verdict.

    The verdict is `example` for a value of at least `example_owners` owners, else `live` when the
    value looks random, else `weak`. Wide candidates stay only where they are live. Rows without a
    remaining span are left out.
    """
    each = found.select("row", "repo", "owner", F.posexplode("spans").alias("at", "span")).withColumn("hash", F.col("span.hash"))
    owned = stored(ownership(each), "ownership")
    told = lookup(each, owned, "hash", ["row", "at"]).withColumn(
        "verdict",
        F.when(F.col("n_owners") >= example_owners, "example").when(F.col("span.looks_live"), "live").otherwise("weak"),
    )
    told = told.where(F.col("span.kind").isin(list(BASE)) | (F.col("verdict") == "live"))
    span = F.struct("at", *[F.col(f"span.{c}").alias(c) for c in ("kind", "start", "end")], "verdict", "n_owners", "n_repos")
    return told.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def report(docs: DataFrame, id_col: str, repo: Column, owner: Column, text: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row of `docs`: counts of base kinds, their digest, all spans as text, counts of verdicts.

    A null or empty text has no spans (digest of an empty text, empty text). Null and repeated ids
    each give their row; null owners are one owner. Other columns and their names play no part. An
    empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("id"), repo.alias("repo"), owner.alias("owner"), F.col(text).alias("text"))
    found = candidates(base, "text", "spans").drop("text").withColumn("row", F.monotonically_increasing_id())
    found = stored(found, "candidates")
    rows = found.select("id", "row").join(judged(found, example_owners), "row", "left")

    def kept(test) -> Column:
        return F.coalesce(F.filter("spans", test), F.array())

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(field: str, value: str) -> Column:
        return F.size(kept(lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    return rows.select(
        F.col("id").alias(id_col),
        *[count("kind", kind) for kind in BASE],
        F.sha2(written(kept(lambda s: s["kind"].isin(list(BASE)))), 256).alias("base_sha256"),
        F.coalesce(written(F.col("spans")), F.lit("")).alias("spans"),
        *[count("verdict", verdict) for verdict in ("live", "weak", "example")],
    )


def redacted(docs: DataFrame, repo: Column, owner: Column, text: str = "text", example_owners: int = EXAMPLE_OWNERS, mask: str = "<secret>") -> DataFrame:
    """`docs` with every credential in `text` replaced by `mask`; copied examples stay as they are.

    Rows, columns and their order of columns stay. Rows without a candidate are passed through in
    place; only the others are stored and meet the verdicts. Overlapping spans are masked as one.
    """
    spans, row, told = (fresh(docs, n) for n in ("spans", "row", "told"))
    marked = candidates(docs, text, spans)
    held = stored(
        marked.where(F.size(spans) > 0).withColumn(row, F.monotonically_increasing_id()), "held"
    )
    found = held.select(F.col(row).alias("row"), repo.alias("repo"), owner.alias("owner"), F.col(spans).alias("spans"))
    verdict = judged(found, example_owners).select(
        F.col("row").alias(row),
        F.transform(F.filter("spans", lambda s: s["verdict"] != "example"), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))).alias(told),
    )
    joined = held.drop(spans).join(verdict, row, "left").drop(row)
    at, names = docs.columns.index(text), docs.columns
    told_at = joined.columns.index(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, cuts in zip(batch.column(at).to_pylist(), batch.column(told_at).to_pylist(), strict=True):
                parts, end = [], 0
                for cut in sorted(cuts or [], key=lambda c: c["a"]):
                    if cut["a"] >= end:
                        parts += [value[end : cut["a"]], mask]
                    end = max(end, cut["b"])
                texts.append("".join([*parts, value[end:]]))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    changed = joined.select(*[F.col(f"`{c}`") for c in names], told).mapInArrow(run, docs.schema)
    return marked.where(F.size(spans) == 0).drop(spans).unionByName(changed)
