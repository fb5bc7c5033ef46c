from __future__ import annotations

import random

import numpy as np

from pyspark.sql import functions as F

from matchlens.llm import decontaminate
from matchlens.llm.decontaminate import build_index, distance, find, flat, report, without_leaks


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for n, a in enumerate(pattern, 1):
        new = [n]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcdefgh ")) + text[at + (kind != 1) :]
    return text


def words(rng, n):
    parts = ["th", "er", "on", "an", "the", "ed", "ha", "es", "of", "tion", "é"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def whole(index, text):
    """Items with a window within its edits anywhere in the text: all windows against all of the text."""
    codes = decontaminate._codes(flat(text or ""))
    return {
        index.ids[n] for n in range(len(index.ids))
        if any(distance(index.codes[n][a:b], codes, k) for a, b, k, _ in index.windows(n))
    }


def test_alignment_against_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        text, pattern = words(rng, 6), words(rng, 2)
        got = distance(decontaminate._codes(pattern), decontaminate._codes(text), 5)
        want = levenshtein_in(pattern, text)
        assert (got[0] if got else None) == (want if want <= 5 else None)


def test_no_window_within_its_edits_is_missed():
    rng = random.Random(2)
    items = [(i, words(rng, rng.choice([8, 20, 40, 80]))) for i in range(25)] + [(98, None), (99, "short")]
    index = build_index(items)
    texts = [None, "", "x"]
    for _ in range(150):
        item = flat(rng.choice(items[:25])[1])
        a = rng.randrange(max(1, len(item) - 90))
        part = item[a : a + rng.choice([60, 96, 150, 400])]
        texts.append(words(rng, rng.randint(0, 60)) + " " + edited(rng, part, rng.randint(0, 12)).upper() + "\n\n" + words(rng, rng.randint(0, 60)))
    texts += [words(rng, 100) for _ in range(30)]
    got = [{f[0] for f in found} for found in find(index, texts)]
    want = [whole(index, t) for t in texts]
    assert got == want and 20 < sum(map(bool, want)) < len(texts) - 40


def test_positions_and_very_long_texts():
    rng = random.Random(3)
    item = flat(words(rng, 60))
    index = build_index([(7, item)])
    before = flat(words(rng, 260_000))
    for at in (1 << 20) - 150, (1 << 20) + 3, len(before):
        text = before[:at] + " " + item + " " + before[at:]
        [(found, edits, start, end)] = find(index, [text])[0]
        assert (found, edits) == (7, 0) and flat(text)[end - 96 : end] in item and start <= end - 96


def test_table_blocks_nulls_and_clashing_columns(spark, docs_of, monkeypatch):
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect()
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    index, rng = build_index(items), random.Random(5)
    rows = [(r.doc_id, r.text) for r in small if len(r.text) < 4000][:60]
    rows += [(5000 + i, words(rng, 30) + " " + items[i % 40][1] + " " + words(rng, 30)) for i in range(20)]
    rows += [(None, items[0][1]), (5000, items[1][1]), (9000, None), (9001, "")]
    docs = docs_of(rows).withColumn("matches", F.lit("m")).withColumn("item_id", F.lit(1)).withColumn("items", F.lit(2))
    want = sorted(((d, tuple(sorted(whole(index, t)))) for d, t in rows), key=str)
    assert sorted(((r.doc_id, tuple(sorted(r["items"]))) for r in report(docs, bench).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1000)
    assert sorted(((r.doc_id, tuple(sorted(r["items"]))) for r in report(docs, bench).collect()), key=str) == want
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(d) for d, i in want if not i)
    assert report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert report(docs.limit(0), bench).count() == 0


def test_passages_are_found_wherever_they_begin():
    rng = random.Random(8)
    items = [(i, words(rng, 60)) for i in range(12)]
    index = build_index(items)
    texts, want = [], []
    for n in range(120):
        item = flat(items[n % 12][1])
        size = rng.choice([88, 96, 110, 130])
        a = rng.randrange(len(item) - size)
        texts.append("QQ " * 40 + item[a : a + size] + " ZZ" * 40)
        want.append(n % 12)
    found = find(index, texts)
    assert [w in {f[0] for f in mine} for w, mine in zip(want, found, strict=True)] == [True] * len(want)


def test_null_and_text_item_ids_and_items_beyond_a_million_characters(spark, docs_of):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(5000)]
    long = " ".join(rng.choice(words, 200_000))
    items = [" ".join(rng.choice(words, 40)) for _ in range(2)]
    benchmark = spark.createDataFrame([("x", items[0]), (None, items[1]), ("long", long)], "item_id string, text string")
    docs = docs_of([(1, " ".join(items)), (2, long[5_000:7_000]), (3, long[1_500_000:1_502_000]), (4, "nothing to see here " * 20)])
    got = {r.doc_id: r["items"] for r in report(docs, benchmark).collect()}
    assert got == {1: ["x", None], 2: ["long"], 3: ["long"], 4: []}
