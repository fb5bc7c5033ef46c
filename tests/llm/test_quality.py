from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from matchlens.llm import quality
from matchlens.llm.quality import CHI_MEDIAN, CHI_REJECT, CHI_REWEIGHT, RIDGE, STEPS, judged, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, lines = Counter(windows), [x for x in text.split("\n") if WORD.search(x)]
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_statistics_against_plain_reading(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\x0by\x0cz\r\n\nq\nq \nq", "é\U0001f600 #*$%&|<> \xa0x"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 60))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice(["u", "v", "w", "ab", "$"]) for _ in range(rng.randint(0, 5))) for _ in range(30)) for _ in range(40)]
    texts += [" ".join(f"w{i % 4000}" for i in range(9000)), " ".join(f"w{i}" for i in range(30_000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: tuple(r)[1:] for r in statistics(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def median(values, step):
    counts = sorted(math.floor(v / step + 0.5) if v >= 0 else -math.floor(-v / step + 0.5) for v in values)
    return counts[math.ceil(0.5 * len(counts)) - 1] * step


def estimate(z):
    cov = np.cov(z.T / 1000, bias=True) + RIDGE * np.eye(z.shape[1])
    return z.mean(0) / 1000, cov


def squared(z, centre, cov):
    diff = z / 1000 - centre
    return np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)


def half(z, far):
    far = np.floor(np.log(far + 1e-6) / 0.01 + 0.5)
    return z[far <= np.sort(far)[math.ceil(0.5 * len(far)) - 1]]


def plain_mcd(z):
    tries = []
    size = np.abs(z / 1000)
    for far in ((size**2).sum(1), size.max(1) ** 2):
        e = estimate(half(z, far))
        for _ in range(STEPS):
            e = estimate(half(z, squared(z, *e)))
        tries.append((np.linalg.slogdet(e[1])[1], e))
    centre, cov = min(tries, key=lambda t: t[0])[1]
    factor = math.exp(median(np.log(squared(z, centre, cov) + 1e-6), 0.01)) / CHI_MEDIAN
    return estimate(z[squared(z, centre, cov * factor) <= CHI_REWEIGHT])


def test_whole_table_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    rows, least = docs.collect(), 60
    stats = {r.doc_id: plain(r.text) for r in rows}
    failed = {d: s[0] < 50 or 100 * s[4] > 50 * s[0] for d, s in stats.items()}
    langs = {r.doc_id: r.lang for r in rows if not failed[r.doc_id]}
    x = {}
    for d in langs:
        n, chars, symbols, dups, repeats = stats[d]
        x[d] = [math.log(n), math.log(chars / n), math.log1p(100 * symbols / chars), math.asin(math.sqrt(min(1, dups / n))), math.asin(math.sqrt(min(1, repeats / n)))]
    floors, z = [0.5, 0.05, 0.25, 0.2, 0.2], {}
    for lang in set(langs.values()):
        ids = [d for d in langs if langs[d] == lang]
        m = [median([x[d][i] for d in ids], 0.001) for i in range(5)]
        unit = [max(1.4826 * median([abs(x[d][i] - m[i]) for d in ids], 0.001), floors[i]) for i in range(5)]
        for d in ids:
            z[d] = [math.floor(abs(v) * 1000 + 0.5) * (1 if v >= 0 else -1) for v in (max(-40, min(40, (x[d][i] - m[i]) / unit[i])) for i in range(5))]
    want = {}
    for level in ("all", "lang", "own"):
        groups = {}
        for r in rows:
            if r.doc_id in langs:
                groups.setdefault({"all": 0, "lang": r.lang, "own": (r.lang, r.source)}[level], []).append(r.doc_id)
        for ids in groups.values():
            if len(ids) >= least:
                points = np.array([z[d] for d in ids], float)
                want |= dict(zip(ids, squared(points, *plain_mcd(points)), strict=True))
    got = {r.doc_id: r for r in judged(docs, least_group=least).collect()}
    assert len(got) == len(rows)
    for d, s in stats.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*s, failed[d])
        if failed[d]:
            assert r.distance is None and not r.kept
        else:
            assert math.isclose(r.distance, want[d], rel_tol=1e-6, abs_tol=1e-6) and r.kept == (want[d] <= CHI_REJECT)
    assert 0 < sum(not r.kept and not r.base_failed for r in got.values()) < 0.1 * len(rows)


def test_nulls_repeats_small_groups_and_clashing_columns(spark, docs_of, monkeypatch):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, text, None, "a", 0), (3, text, "en", None, 0), (3, text, "en", None, 0), (4, "a b c", "en", "a", 0)]
    docs = docs_of(rows).withColumn("row", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("key", F.lit(0)).withColumn("_words", F.lit(0))
    monkeypatch.setattr(quality, "attach", lambda rows, small, key, spread, limit=0: quality.lookup(rows, quality.stored(small, "t"), key, spread))
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in judged(docs, least_group=2).collect()), key=str)
    want = [(1, 0, True, False), (2, 0, True, False), (None, 80, False, True), (3, 80, False, True), (3, 80, False, True), (4, 3, True, False)]
    assert got == sorted(want, key=str)
    assert judged(docs.limit(0)).count() == 0


def test_no_passing_row_is_unmeasured_in_a_small_table(spark, small_docs):
    for docs in (small_docs, small_docs.limit(9)):
        assert judged(docs).where("not base_failed and distance is null").count() == 0
