from __future__ import annotations

from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from matchlens.llm.components import components
from matchlens.llm.simhash import fingerprint, keep_one, links, near_duplicates


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))
    return value - (1 << 64) if value >> 63 else value


def plain_groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def close(a, b, bits=3):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= bits


def test_fingerprint_against_plain_reading():
    for text in [None, "", " \t\n", "One", "one TWO", "A b c", "a b c d e a b c", "É x y z w", "x " * 70000]:
        assert fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_whole_table_against_all_pairs(spark, small_docs):
    rows = small_docs.select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_groups(prints, [p for p in combinations(prints, 2) if close(prints[p[0]], prints[p[1]])])
    got = near_duplicates(small_docs).collect()
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == {d: (prints[d], want[d]) for d in prints}
    assert len(got) == len(rows) and len(set(want.values())) < len(rows)


def test_links_cover_all_near_pairs_in_plain_and_crowded_slots(spark):
    base = 0x0123456789ABCDEF
    prints = {base, -1, 0, -(1 << 63), 7}
    for a in range(0, 64, 3):
        for b in range(1, 64, 11):
            for c in range(2, 64, 17):
                v = base ^ 1 << a ^ 1 << b ^ 1 << c
                prints.add(v - (1 << 64) if v >> 63 else v)
    want = {(min(p), max(p)) for p in combinations(prints, 2) if close(*p)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for crowded in (1000, 2):
        got = {(min(r), max(r)) for r in links(frame, crowded=crowded).collect()}
        assert got == want


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}


def test_nulls_ties_repeats_and_clashing_columns(spark, docs_of):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "alpha beta gamma delta"), (4, "alpha beta gamma delta"), (4, "alpha beta gamma delta"), (8, "q w e r t y")]
    docs = docs_of(rows).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("_part", F.lit(2)).withColumn("_rank", F.lit(0))
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (None, 4), (4, 4), (4, 4), (8, 8)], key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, None, 8], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_keep_one_loses_no_text_of_a_repeated_id(spark, docs_of):
    a, b, c = ("alpha beta gamma delta epsilon " * 3), ("one two three four five six " * 3), ("red green blue black white grey " * 3)
    docs = docs_of([(1, a), (1, b), (2, a), (2, c), (3, b), (1, a), (4, None), (4, None)])
    assert sorted((r.doc_id, r.text) for r in keep_one(docs.where("text is not null")).collect()) == sorted([(1, a), (1, b), (2, c)])
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 1, 2, 4]


def test_exploded_sides_are_not_broadcast(spark):
    distinct = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    for crowded in (256, 0):
        plan = links(distinct, crowded=crowded)._jdf.queryExecution().sparkPlan().toString().split("\n")
        pairs = [line for line in plan if "Join" in line and "bit_count" in line]
        assert len(pairs) == 2 and all("SortMergeJoin" in line for line in pairs)
        others = [line for line in plan if "Join" in line and "bit_count" not in line]
        assert others and all("LeftSemi" in line for line in others)  # which may build its right side only
