from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchlens.llm import merkle
from matchlens.llm.queries import op13_midstate_manifest


def record(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def joined(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([joined(below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def climb(levels, i, arity, digest, proof):
    for level in levels[:-1]:
        start = i // arity * arity
        run = level[start : start + arity]
        proof += [d for k, d in enumerate(run) if k != i - start]
        run[i - start] = digest
        digest, i = joined(run), i // arity
    return digest


def brute(rows, arity=2):
    """Counter of the expected rows, hashing whole runs instead of resuming states."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id, record(*r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: tree([leaf for _, leaf, _ in groups[g]], arity) for g in order}
    top = tree([trees[g][-1][0] for g in order], arity)
    out = Counter()
    for k, g in enumerate(order):
        for i, (doc_id, leaf, r) in enumerate(groups[g]):
            more = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r.n_chars is not None
            proof = []
            digest = climb(trees[g], i, arity, record(r.doc_id, r.source, r.lang, r.n_chars + more if r.n_chars is not None else None, r.text), proof)
            digest = climb(top, k, arity, digest, proof)
            out[doc_id, leaf, trees[g][-1][0], top[-1][0], joined(proof), digest, digest == top[-1][0]] += 1
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def found(docs, **settings):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)")
    out = merkle.verify(docs, {"n_chars": F.when(hit, more + 1).otherwise(more)}, **settings)
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("arity", "height"), [(2, 10), (2, 2), (3, 1)])
def test_equals_whole_runs(spark, small_docs, arity, height):
    got = found(small_docs, arity=arity, height=height)
    assert got == brute(small_docs.select(FIELDS).collect(), arity)
    assert any(not k[-1] for k in got) and any(k[-1] for k in got)


def test_nulls_repeats_empty_and_long_texts(spark, docs_of):
    rows = [(i, f"t{i}", lang, "s", 2) for lang, n in [("en", 9), ("é", 3), ("z", 1)] for i in range(n)]
    rows += [(None, None, None, None, None), (None, "", None, None, None), (7, None, None, "", None), (0, "x", "", "s", 1)]
    rows += [(5, "same", "en", "s", 4)] * 6 + [(49, "ü" * 300_000, "en", "s", 300_000), (2**62, "x", "en", "s", 2**63 - 1)]
    docs = docs_of(rows)
    want = brute(docs.select(FIELDS).collect())
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "grp", "leaf", "i", "n", "digest", "run", "tie", "edited")])
    for height in (1, 3, 10):
        assert found(clash, height=height) == want
    assert sum(want.values()) == len(rows)


def test_untouched_rows_verify_and_one_row_is_its_own_root(spark, docs_of):
    assert all(r.verified and r.folded_root == r.root for r in merkle.verify(docs_of([(i, "a") for i in range(20)]), height=2).collect())
    (only,) = merkle.verify(docs_of([(1, "a")])).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root == record(1, "src0", "en", 1, "a")
    assert only.proof_sha256 == hashlib.sha256(b"").hexdigest() and only.verified
    assert merkle.verify(docs_of([(1, "a")]).limit(0)).count() == 0


def test_query(spark):
    out = op13_midstate_manifest(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 200
