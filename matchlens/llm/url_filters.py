"""URL filters with dated lists: every capture is judged by the entries active when it was fetched.

List entries (add or remove a pattern at a date) become validity intervals. A URL is listed through
its host, the domains above it, and the path prefixes below it; the most specific active pattern
decides. The as-of join works on distinct (pattern, day) pairs, so a host with a third of all
captures costs as many pairs as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import lookup, stored

#: Days that share one key of the as-of join.
BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and final dots; null where there is none. An IPv6 host keeps its brackets."""
    place = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1), r"[.]+$", ""))
    return F.when(host != "", host)


def patterns_of(url: Column) -> Column:
    """All patterns that list a URL: its host and the domains above, and host plus each path prefix."""
    host, path = host_of(url), F.regexp_extract(url, r"^[^:]*://[^/?#]*/([^?#]*)", 1)
    labels, steps = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(
        F.size(steps) > 0,
        F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(steps, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) of entries (list, pattern, action, date).

    An `add` holds from its date until the next entry of its list and pattern, the last one for
    ever (null). Of entries of one day a `remove` counts. Entries without list, pattern, date or a
    known action do not count. Days are made distinct first, so a pattern's window holds its days.
    """
    known = entries.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "pattern", "date"])
    days = known.groupBy("list", "pattern", F.col("date").cast("date").alias("date")).agg(
        F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed")
    )
    order = Window.partitionBy("list", "pattern").orderBy("date")
    return (
        days.withColumn("valid_to", F.lead("date").over(order))
        .where("removed = 0")
        .select("list", "pattern", F.col("date").alias("valid_from"), "valid_to")
    )


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(BUCKET_DAYS)).cast("int")


def active(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """(pattern, day, list, valid_from) of every interval active on the day, for distinct (pattern, day) pairs.

    Intervals are laid out over the buckets of days that the pairs span; within a bucket a pattern
    has at most BUCKET_DAYS days and as many intervals of a list.
    """
    last = pairs.agg(F.max("day")).first()[0]
    if last is None:
        return pairs.join(spans, "pattern").select("pattern", "day", "list", "valid_from")
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
    laid = spans.where(F.col("valid_from") <= F.lit(last)).withColumn(
        "bucket", F.explode(F.sequence(_bucket(F.col("valid_from")), _bucket(F.greatest(until, "valid_from"))))
    )
    days = pairs.withColumn("bucket", _bucket(F.col("day")))
    found = days.join(laid, ["pattern", "bucket"])
    return found.where((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))).select(
        "pattern", "day", "list", "valid_from"
    )


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url", fetched: str = "fetch_date") -> DataFrame:
    """One row per row of `captures`: (id, url, host, fetch_date, decision, pattern, listed_since, n_active).

    The longest active pattern decides, a block list before an allow list at the same one: `blocked`,
    `allowed`, or `unlisted` when nothing is active, the URL has no host, or URL or date is null.
    `n_active` counts the active (list, pattern) pairs. Null and repeated ids each give their row.
    Other columns and their names play no part. An empty table gives an empty one.
    """
    base = captures.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(fetched).cast("date").alias("day"))
    rows = stored(base.withColumn("host", host_of(F.col("url"))).withColumn("row", F.monotonically_increasing_id()), "captures")
    keys = rows.where(F.col("day").isNotNull()).select("row", "day", F.explode(patterns_of(F.col("url"))).alias("pattern"))
    pairs = stored(keys.select("pattern", "day").distinct(), "pairs")
    held = active(pairs, intervals(entries))
    states = held.groupBy("pattern", "day").agg(
        F.min(F.when(F.col("list") == "block", F.struct(F.lit(0).alias("rank"), "valid_from")).otherwise(F.struct(F.lit(1).alias("rank"), "valid_from"))).alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    states = stored(states.select(F.concat_ws(" ", "pattern", F.col("day").cast("string")).alias("key"), "top", "n"), "states")
    keyed = keys.withColumn("key", F.concat_ws(" ", "pattern", F.col("day").cast("string")))
    told = lookup(keyed, states, "key", ["row"]).where(F.col("n").isNotNull())
    best = told.groupBy("row").agg(
        F.max_by(F.struct("pattern", "top"), F.length("pattern")).alias("best"), F.sum("n").alias("n_active")
    )
    decision = F.when(F.col("best").isNull(), "unlisted").when(F.col("best.top.rank") == 0, "blocked").otherwise("allowed")
    return rows.join(best, "row", "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url), "host", F.col("day").alias(fetched), decision.alias("decision"),
        F.col("best.pattern").alias("pattern"), F.col("best.top.valid_from").alias("listed_since"),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
    )
