"""Quality rules: base statistics of a text, and robust multivariate outliers among documents.

Each document becomes a vector of transformed statistics. Per language and source, and for small
groups per language or over all, the minimum-covariance-determinant estimate gives a centre and a spread that outliers do
not pull; documents far from the centre by Mahalanobis distance are rejected. Everything is built
from DataFrame functions: counts, sums and lookups on small vectors.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import lookup, stored

#: The six ASCII blanks between words, and the counted symbols: fixed values of the contract.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Least words, and the share of repeated words in percent, of the base rules: fixed values.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Chi-square values for five dimensions: median, 0.975 (reweighting) and 1 - 1e-6 (rejection); fixed values.
CHI_MEDIAN, CHI_REWEIGHT, CHI_REJECT = 4.351, 12.833, 37.55
#: Documents that five dimensions need for an estimate of a group's own; smaller ones take their language's, or that of all.
LEAST_GROUP = 40
#: Vector entries are kept to this many scale units, in steps of a thousandth, so that sums are exact.
REACH, STEP = 40, 1000
#: Concentration steps.
STEPS = 3
#: Spread, in scale units squared, that every entry has besides its estimate.
RIDGE = 1.0


def _let(value: Column, body) -> Column:
    """`body` of `value`, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(flagged: Column) -> Column:
    """How many positions lie in 3-word windows that begin at the ascending positions `flagged`."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        flagged, start,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without `text`, with the base statistics of each whole text; null texts count as empty.

    Three-word windows are compared by a 64-bit hash of their words.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    names = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *keep,
        F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_lines"),
    )
    hashed = split.select(
        *names, "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _let(
            F.col("_words"),
            lambda w: F.when(
                F.size(w) > 2,
                F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))),
            ).otherwise(F.array().cast("array<bigint>")),
        ).alias("_windows"),
    )
    ordered = hashed.select("*", F.sort_array("_windows").alias("_sorted"))
    twice = ordered.select(
        "*",
        _let(
            F.col("_sorted"),
            lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))),
        ).alias("_twice"),
    ).drop("_sorted")
    few = F.filter(F.transform("_windows", lambda x, i: F.when(F.array_contains(F.col("_twice"), x), i)), lambda i: i.isNotNull())
    many = _let(
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | (F.get(s, k + 1)["x"] == e["x"])),
                lambda e: e["i"],
            )
        ),
    )
    repeated = F.when(F.size("_twice") == 0, F.lit(0).cast("long")).when(F.size("_twice") <= 16, _covered(few)).otherwise(_covered(many))
    return twice.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))


def features() -> list[tuple[Column, float]]:
    """(transformed statistic, least spread) of the vector, for documents with words."""
    words, chars = F.col("n_words"), F.col("word_chars")

    def share(part: str) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / words)))

    return [
        (F.log(words), 0.5),
        (F.log(chars / words), 0.05),
        (F.log1p(100 * F.col("n_symbols") / chars), 0.25),
        (share("n_dup_lines"), 0.2),
        (share("n_repeat_words"), 0.2),
    ]


def _quantile(rows: DataFrame, by: list[str], value: Column, step: float, share: float, out: str) -> DataFrame:
    """(keys, out) for each key: the least multiple of `step` with at least `share` of the rows at or below it.

    Rows are counted by step first, so what meets for a key is its number of steps, not of rows.
    """
    counts = rows.groupBy(*by, F.round(value / step).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    below = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("bin")))
    below = below.withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return below.where(F.col("upto") >= F.col("all") * share).groupBy(*by).agg((F.min("bin") * step).alias(out))


def _medians(rows: DataFrame, key: str, values: list[Column], names: list[str]) -> DataFrame:
    """(key, names...): the medians of several columns for each key, to a thousandth."""
    entries = F.array(*[F.struct(F.lit(i).alias("at"), v.alias("value")) for i, v in enumerate(values)])
    found = _quantile(rows.select(key, F.inline(entries)), [key, "at"], F.col("value"), 0.001, 0.5, "middle")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("at") == i, F.col("middle"))).alias(n) for i, n in enumerate(names)])


def attach(rows: DataFrame, small: DataFrame, key: str, spread: list[str], limit: int = 50_000) -> DataFrame:
    """Left join to a table of one row per key: broadcast when it has few rows, else by `lookup`."""
    held = stored(small, "estimates")
    if held.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(held), key, "left")
    return lookup(rows, held, key, spread)


def _estimate(rows: DataFrame, by: list[str], p: int) -> DataFrame:
    """Centre, lower Cholesky factor and log determinant of each group of the integer vectors z0..."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(f"z{i}").cast("double").alias(f"s{i}") for i in range(p)],
        *[F.sum((F.col(f"z{i}") * F.col(f"z{j}")).cast("double")).alias(f"q{i}{j}") for i, j in pairs],
    )
    spread = [((F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") / STEP**2).alias(f"v{i}{j}") for i, j in pairs]
    out = sums.select(*by, *[(F.col(f"s{i}") / F.col("n") / STEP).alias(f"c{i}") for i in range(p)], *spread)
    return _factored(out, by, p)


def _factored(out: DataFrame, by: list[str], p: int) -> DataFrame:
    """Replace the covariances v.. by the Cholesky factor l.. and the log determinant."""
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"v{i}{j}") + (F.lit(RIDGE) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    logdet = reduce(add, [F.log(F.col(f"l{i}{i}")) for i in range(p)])
    return out.select(*by, *[f"c{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], logdet.alias("logdet"))


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of z0... from the centre c0... under the factor l..."""
    solved: list[Column] = []
    for i in range(p):
        rest = F.col(f"z{i}") / STEP - F.col(f"c{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    return reduce(add, [s * s for s in solved])


def _within(rows: DataFrame, by: str, squared: Column, share: float = 0.5) -> DataFrame:
    """The rows whose squared distance is at or below the quantile `share` of their group, ties included."""
    step = 0.01
    far = rows.withColumn("far", F.round(F.log(squared + 1e-6) / step).cast("long"))
    edge = _quantile(far, [by], F.col("far"), 1, share, "edge")
    return attach(far, edge, by, ["row"]).where(F.col("far") <= F.col("edge"))


def mcd(vectors: DataFrame, p: int, steps: int = STEPS) -> DataFrame:
    """(key, centre c0..., factor l00...) for every key of the stored table (row, key, z0...).

    Two deterministic starts, the half of the rows nearest to the median by sum and by largest
    entry, go through `steps` concentration steps: estimate on the nearest half, measure all rows
    again. The start with the smaller determinant wins, is scaled to the median of the chi-square
    distribution and re-estimated once on the rows within its 97.5 % distance.
    """
    z = [F.abs(F.col(f"z{i}")).cast("double") / STEP for i in range(p)]
    sizes = F.array(*[F.struct(F.lit(n).alias("start"), v.alias("size")) for n, v in (("sum", reduce(add, [a * a for a in z])), ("top", F.greatest(*z) * F.greatest(*z)))])
    names = ["row", "key", *[f"z{i}" for i in range(p)]]
    tried = vectors.select(*names, F.inline(sizes)).withColumn("try", F.concat_ws("|", "start", "key"))
    estimate = _estimate(_within(tried, "try", F.col("size")), ["try"], p)
    for _ in range(steps):
        measured = attach(tried, estimate, "try", ["row"])
        near = _within(measured.select(*names, "try", _distance(p).alias("squared")), "try", F.col("squared"))
        estimate = _estimate(near, ["try"], p)
    shape = [f"c{i}" for i in range(p)] + [f"l{i}{j}" for i in range(p) for j in range(i + 1)]
    keyed = stored(estimate, "tries").withColumn("key", F.expr("substring(try, instr(try, '|') + 1)"))
    best = keyed.groupBy("key").agg(F.min_by(F.struct(*shape), F.struct("logdet", "try")).alias("e")).select("key", "e.*")
    measured = attach(vectors, best, "key", ["row"]).select("key", _distance(p).alias("squared"))
    middle = _quantile(measured, ["key"], F.log(F.col("squared") + 1e-6), 0.01, 0.5, "middle")
    factor = F.sqrt(F.greatest(F.exp("middle") / CHI_MEDIAN, F.lit(1e-6)))
    scaled = best.join(middle, "key").select("key", *shape[:p], *[(F.col(c) * factor).alias(c) for c in shape[p:]])
    near = attach(vectors, scaled, "key", ["row"]).where(_distance(p) <= CHI_REWEIGHT).select(*names)
    return _estimate(near, ["key"], p).drop("logdet")


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per row of `docs`: id, the base statistics, base_failed, distance, kept.

    Rows that fail a base rule are not kept and take no part in the estimates. The rest is measured
    against its language and source when that group has `least_group` such rows, else against its
    language, else against all rows, however few there are. Null languages and sources are groups of their own;
    null and empty texts fail for having no words. Ids may be null or repeated. Other columns and
    their names play no part. An empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = stored(
        statistics(base)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))),
        "statistics",
    )
    terms = features()
    p, floors = len(terms), [floor for _, floor in terms]
    lang_key = F.concat(F.lit("l"), F.to_json(F.struct("lang")))
    own_key = F.concat(F.lit("s"), F.to_json(F.struct("lang", "source")))
    raw = rows.where(~F.col("base_failed")).select(
        "row", lang_key.alias("lang_key"), own_key.alias("own_key"), *[f.alias(f"x{i}") for i, (f, _) in enumerate(terms)]
    )
    # one median and spread per language puts all its groups on one scale
    xs, ms, spreads = ([f"{c}{i}" for i in range(p)] for c in "xma")
    centred = stored(attach(raw, _medians(raw, "lang_key", [F.col(x) for x in xs], ms), "lang_key", ["row"]), "centred")
    deviations = [F.abs(F.col(x) - F.col(m)) for x, m in zip(xs, ms, strict=True)]
    spread = attach(centred, _medians(centred, "lang_key", deviations, spreads), "lang_key", ["row"])
    z = []
    for i, (x, m, a) in enumerate(zip(xs, ms, spreads, strict=True)):
        unit = F.greatest(F.lit(1.4826) * F.col(a), F.lit(floors[i]))
        entry = F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), (F.col(x) - F.col(m)) / unit))
        z.append(F.round(entry * STEP).cast("long").alias(f"z{i}"))
    scaled = stored(spread.select("row", "lang_key", "own_key", *z), "scaled")
    names = [f"z{i}" for i in range(p)]
    levels = scaled.select("row", F.explode(F.array(F.lit("all"), "lang_key", "own_key")).alias("key"), *names)
    sizes = levels.groupBy("key").count().where((F.col("count") >= least_group) | (F.col("key") == "all")).select("key", F.lit(True).alias("large"))
    vectors = stored(attach(levels, sizes, "key", ["row"]).where("large").drop("large"), "vectors")
    measured = attach(vectors, mcd(vectors, p), "key", ["row"]).select(
        "row", F.substring("key", 1, 1).alias("level"), _distance(p).alias("distance")
    )
    nearest = measured.groupBy("row").agg(F.max_by("distance", "level").alias("distance"))
    return rows.join(nearest, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CHI_REJECT)).alias("kept"),
    )
