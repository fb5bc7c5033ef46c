from __future__ import annotations

from itertools import combinations

from tokenizers import Tokenizer

import corpus_pipeline
from matchlens.llm.decontaminate import build_index
from matchlens.llm.queries import tokenizer_path
from matchlens.llm.secrets import BASE, looks_live, scan
from matchlens.llm.toxicity import report
from tests.llm.test_decontaminate import whole
from tests.llm.test_simhash import close, plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.01"


def masked(text, spans):
    end, out = 0, ""
    for a, b in sorted(spans):
        if a >= end:
            out += text[end:a] + "<secret>"
        end = max(end, b)
    return out + text[end:]


def test_stages_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 260")  # the brute force compares all with all
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    by_name = dict(corpus_pipeline.STAGES)

    def stage(name, frame):
        out = by_name[name](spark, frame, SF)
        rows = out.collect()
        return (spark.createDataFrame(rows, out.schema) if rows else out), rows

    frame, rows = stage("toxicity", docs)
    scores = {r.doc_id: r.score for r in report(docs, labels).collect()}
    assert {r.doc_id for r in rows} == {d for d, s in scores.items() if s < 0.7}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    roots = plain_groups(prints, [p for p in combinations(prints, 2) if close(prints[p[0]], prints[p[1]])])
    frame, rows = stage("near_duplicates", frame)
    assert sorted(r.doc_id for r in rows) == sorted(set(roots.values())) and len(rows) < len(prints)
    index = build_index([(r.item_id, r.text) for r in bench.collect()])
    short = [r for r in rows if len(r.text) < 3000]
    leaks = {r.doc_id for r in short if whole(index, r.text)}
    before = {r.doc_id for r in rows}
    frame, rows = stage("decontamination", frame)
    kept = {r.doc_id for r in rows}
    assert kept <= before and all((r.doc_id in kept) == (r.doc_id not in leaks) for r in short) and leaks
    owners = {}
    for r in rows:
        for s in scan(r.text):
            owners.setdefault(s[3], set()).add(r.source)
    want = {
        r.doc_id: masked(r.text, [s[1:3] for s in scan(r.text) if len(owners[s[3]]) < 5 and (s[0] in BASE or looks_live(s[3]))]) for r in rows
    }
    frame, rows = stage("secrets", frame)
    assert frame.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {d: (t, len(t)) for d, t in want.items()}
    _, rows = stage("tokens", frame)
    library = Tokenizer.from_file(tokenizer_path())
    assert len(rows) == len(want)
    for r in rows:
        ids = library.encode(want[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r["ids"], r.decoded) == (len(ids), ids, library.decode(ids, skip_special_tokens=False))


def test_run_joins_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = out.collect()
    assert 0 < len(rows) < 200 and all(r.n_tokens == len(r["ids"]) for r in rows)
