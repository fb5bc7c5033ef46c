from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from matchlens.llm.secrets import BASE, looks_live, redacted, report, scan

PLAIN = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
VALUE = "".join(random.Random(5).choices("0123456789abcdef", k=40))


def plain_base(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(PLAIN) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_scan_against_plain_patterns():
    rng = random.Random(1)
    bits = ["password", "API_KEY", "apikey", "toKen", "ſecret", "toKen", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCD1234EFGH5678", "abc", VALUE, "x", "é", "\n", "\t", "a=b", "deadbeef"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert [s[:3] for s in scan(text) if s[0] in BASE] == plain_base(text)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    spans = {r.doc_id: scan(r.text) for r in rows}
    owners = {}
    for r in rows:
        for s in spans[r.doc_id]:
            owners.setdefault(s[3], set()).add(r.source)
    got = {r.doc_id: r for r in report(docs, "doc_id", F.concat_ws("/", "source", "lang"), F.col("source"), example_owners=2).collect()}
    assert len(got) == len(rows) and any(spans.values())
    for r in rows:
        told = [(s, "example" if len(owners[s[3]]) >= 2 else "live" if looks_live(s[3]) else "weak") for s in spans[r.doc_id]]
        told = [(s, v) for s, v in told if s[0] in BASE or v == "live"]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(r.text))
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == k for s, _ in told) for k in BASE]
        assert row.spans == ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s, _ in told)
        assert [row.n_live, row.n_weak, row.n_example] == [sum(v == x for _, v in told) for x in ("live", "weak", "example")]


def test_examples_stay_and_credentials_go(spark, docs_of):
    shared = "token = " + "0123456789abcdef" * 2
    rows = [(i, f"see {shared} here", "en", f"src{i}", 0) for i in range(6)]
    rows += [(10, f"my token = '{VALUE}' end", "en", "a", 0), (11, "nothing", "en", "a", 0), (12, None, "en", None, 0), (None, f"é {VALUE.upper()} z", None, None, 0)]
    rows += [(13, "password: changeme", "en", "b", 0), (13, "password: changeme", "en", "b", 0)]
    docs = docs_of(rows).withColumn("spans", F.lit(1)).withColumn("row", F.lit("r")).withColumn("told", F.lit("t"))
    out = redacted(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(i, f"see {shared} here") for i in range(6)]
    want += [(10, "my <secret>' end"), (11, "nothing"), (12, None), (None, "é <secret> z"), (13, "<secret>"), (13, "<secret>")]
    assert got == sorted(want, key=str)
    told = {r.doc_id: (r.n_live, r.n_weak, r.n_example, r.spans) for r in report(docs, "doc_id", F.col("source"), F.col("source")).collect()}
    assert told[0] == (0, 0, 2, "assign:4:44,hex:12:44") and told[10][:3] == (2, 0, 0)
    assert told[13] == (0, 1, 0, "assign:0:18") and told[None] == (1, 0, 0, "upper:2:42") and told[12] == (0, 0, 0, "")
    assert report(docs.limit(0), "doc_id", F.col("source"), F.col("source")).count() == 0
    assert redacted(docs.limit(0), F.col("source"), F.col("source")).count() == 0
