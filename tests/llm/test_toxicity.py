from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import toxicity
from matchlens.llm.toxicity import Scorer, fit, held_out, normal, report, train, windows, without_toxic

BAD = ["worthless", "pathetic", "disgusting", "moronic", "vequande", "loweischaft"]


def prose(rng, n, bad=0):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    for i in rng.sample(range(n), min(n, bad)):
        words[i] = rng.choice(BAD)
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    rows = []
    for i in range(900):
        n = rng.randint(40, 300)
        toxic = i % 4 == 0
        rows.append((i, prose(rng, n, max(2, n // 40) if toxic else 0), int(toxic)))
    return rows


def test_windows_cover_whole_texts():
    words = normal("One two-three FOUR_five. " * 5000)
    assert words[:5] == ["one", "two", "three", "four", "five"]
    assert b" ".join(w.strip() for w in windows(words, 8, 8)).split() == [w.encode() for w in words]
    for n in range(1, 40):
        cut = [w.split() for w in windows(words[:n])]
        assert cut[0] == [w.encode() for w in words[:8][:n]] and cut[-1][-1] == words[n - 1].encode()
        assert all(a[4:] == b[: len(a) - 4] for a, b in zip(cut, cut[1:], strict=False))
    assert windows([]) == [b" "] and normal(None) == []


def test_held_out_accuracy(spark, labelled, docs_of):
    docs = docs_of([(i, t) for i, t, _ in labelled])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in labelled], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in report(docs, labels).collect()}
    assert len(got) == len(labelled)
    truth = {i: t for i, _, t in labelled}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    test = [r for r in got.values() if r.held_out]
    toxic = [r for r in test if truth[r.doc_id]]
    clean = [r for r in test if not truth[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)
    # labels of held-out rows and other columns play no part
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in report(docs.withColumn("lang", F.lit("xx")), turned).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_scores_against_plain_sums(labelled):
    model = fit([(t, k) for _, t, k in labelled[:400]])
    scorer = Scorer(model.ordinary, model.toxic)
    ordinary, toxic = scorer.pair
    for _, text, _ in labelled[400:420]:
        gains = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(normal(text))]
        row = scorer.features(text)
        assert row[0] == pytest.approx(sum(gains) / len(gains)) and row[1] == pytest.approx(sum(max(g, 0) for g in gains) / len(gains))
        assert row[3] == pytest.approx(sum(g >= 3 for g in gains) / len(gains))


def test_nulls_repeats_missing_labels_and_clashing_columns(spark, labelled, docs_of):
    long = prose(random.Random(4), 60_000)
    rows = [(i, t) for i, t, _ in labelled[:200]] + [(1000, None), (1001, ""), (None, "worthless moronic " * 20), (1002, long), (1002, long), (3, "other text of the same id")]
    docs = docs_of(rows).withColumn("score", F.lit("s")).withColumn("predicted", F.lit(9)).withColumn("label", F.lit(1)).withColumn("key", F.lit("k"))
    labels = spark.createDataFrame([(i, t) for i, _, t in labelled[:200]] + [(None, 1), (5, None), (6, 7), (8, 0), (8, 1)], "doc_id long, toxic int")
    got = report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert len({r.score for r in got if r.doc_id == 1002}) == 1
    assert without_toxic(docs, labels).columns == docs.columns
    for some in (labels.limit(0), labels.where("toxic = 0")):
        model = train(docs, some)
        assert all(r.predicted == 0 for r in toxicity.report(docs, some).collect()) and model.weights
    assert report(docs.limit(0), labels).count() == 0


def test_strings_are_counted_in_parts(monkeypatch):
    """The same strings whatever the parts, and memory by the part, not by all strings of the sample."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    toxic = [" ".join([*(word() for _ in range(2_000)), "vile slur here"]) for _ in range(60)]
    ordinary = [" ".join(word() for _ in range(200)) for _ in range(60)]
    tracemalloc.start()
    try:
        found = toxicity._toxic_strings(toxic, ordinary, 6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {int(x) for x in toxicity._grams(b" vile slur here ", 6)} <= {int(x) for x in found}
    assert peak < 30 * sum(map(len, toxic))
    monkeypatch.setattr(toxicity, "STRINGS_AT_ONCE", 1 << 40)
    np.testing.assert_array_equal(found, toxicity._toxic_strings(toxic, ordinary, 6))
    assert len(toxicity._toxic_strings([], ordinary, 6)) == 0
