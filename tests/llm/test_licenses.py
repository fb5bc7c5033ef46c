from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from check import compare
from matchlens.llm.licenses import TEMPLATES, ancestors, report, terms_of
from matchlens.llm.queries import ORACLES, QUERIES


def terms(text):
    return [t for t in (x.strip(".-") for x in re.split(r"(?:[^\w.\-]|_)+", text.lower())) if t]


def cosine(unit, template, idf):
    def vector(body):
        out = {}
        for t in body:
            out[t] = out.get(t, 0) + idf[t]
        return out

    a, b = vector(unit), vector(terms(template))
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(t, 0) for t, v in a.items()) / norm if norm else 0.0


def licence_file(path):
    return bool(path and re.match(r"(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$", path.rsplit("/", 1)[-1].lower()))


def units(path, text):
    lines = [terms(line) for line in (text or "").split("\n")]
    out, block = [(i, 0, body) for i, body in enumerate(lines)], []
    for i, body in enumerate([*lines, []]):
        if body:
            block.append((i, body))
        else:
            if len(block) > 1:
                out.append((block[0][0], 1, [t for _, x in block for t in x]))
            block = []
    if licence_file(path) and len(lines) > 1:
        out.append((0, 2, [t for body in lines for t in body]))
    return out


def frequencies(rows):
    texts = [set(terms(text or "")) for *_, text in rows]
    known = {t for _, body in TEMPLATES for t in terms(body)}.union(*texts)
    return {t: math.log((1 + len(rows)) / (1 + sum(t in x for x in texts))) + 1 for t in known}


def plain(rows, threshold=0.8):
    idf = frequencies(rows)
    own = []
    for _, path, text in rows:
        found = [(-round(cosine(unit, body, idf), 6), n, scope, i) for n, scope, unit in units(path, text) for i, (_, body) in enumerate(TEMPLATES)]
        best = min(found)
        own.append((TEMPLATES[best[3]][0], -best[0], best[1], ["line", "block", "file"][best[2]]) if -best[0] >= threshold else None)
    speaking = {}
    for (_, path, _), o in sorted(zip(rows, own, strict=True), key=lambda x: (str(x[0][1]), str(x[1]))):
        if o and licence_file(path):
            speaking.setdefault(path.rpartition("/")[0].strip("/"), o[0])
    out = []
    for (doc, path, _), o in zip(rows, own, strict=True):
        at, given = path.rpartition("/")[0].strip("/") if path is not None else None, None
        while at is not None and o is None:
            if at in speaking:
                given = at
                break
            at = at.rpartition("/")[0] if at else None
        out.append((doc, path, *(o or (None, None, None, None)), o[0] if o else speaking.get(given), given))
    return out


def test_query_against_sql(spark):
    from check import duck

    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op9_license_inheritance"](spark, sf), duck(sf), ORACLES["op9_license_inheritance"]) is None


def test_terms_and_ancestors(spark):
    texts = ["v. 2.0. -a-b- a.-.b é_x ..", "", "... --", "(CC BY-NC 4.0)"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(terms_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [["v", "2.0", "a-b", "a.-.b", "é", "x"], [], [], ["cc", "by-nc", "4.0"]]
    got = spark.createDataFrame([("a/b/c",), ("",), (None,)], "d string").select(ancestors(F.col("d"))).collect()
    assert [r[0] for r in got] == [["a/b/c", "a/b", "a", ""], [""], None]


def test_against_brute_force(spark):
    rng = random.Random(6)
    words = "the of this work under a license public version software is and to in general copy 2.0 4.0 cc by".split()
    rows = []
    for i in range(160):
        body = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.4:
            statement = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                statement[rng.randrange(len(statement))] = rng.choice(words)
            cut = rng.randint(0, len(statement))
            wrapped = [" ".join(statement).upper()] if rng.random() < 0.5 else ["# " + " ".join(statement[:cut]), "# " + " ".join(statement[cut:])]
            body.insert(rng.randint(0, len(body)), "\n".join(["", *wrapped, " *"] if rng.random() < 0.7 else wrapped))
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))
        rows.append((i, f"{folder}/{rng.choice(['LICENSE', 'copying.txt', f'x{i}.py'])}".lstrip("/"), "\n".join(body)))
    rows += [(500, "a/b/none.txt", None), (501, None, TEMPLATES[0][1]), (502, None, "x"), (None, "a/y", ""), (503, "/abs/x", "q"), (503, "/abs/x", "q"), (504, "/abs/LICENCE", TEMPLATES[3][1])]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("z")).withColumn("row", F.lit("r")).withColumn("dir", F.lit(1)).withColumn("line", F.lit("l"))
    got = [(r.doc_id, r.path, r.own_license, r.similarity, r.line, r.scope, r.license, r.inherited_from) for r in report(files).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    assert sum(g[7] is not None for g in got) > 20
    assert report(files.limit(0)).count() == 0


def test_every_term_weighs_by_its_own_frequency(spark):
    rows = [(i, f"d/f{i}", f"released under the words and more {i}") for i in range(300)]
    rows += [(300, "d/a", "Released under the MIT License and"), (301, "d/b", "Released under the MIT License zyzzyva"), (302, "d/c", "and\n" + TEMPLATES[1][1] + " and and")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_license, r.similarity, r.line) for r in report(files).collect()}
    assert got == {r[0]: r[2:5] for r in plain(rows)}
    assert got[300][0] == "MIT" and got[302][0] == "Apache-2.0"


def test_whole_files_wrapped_headers_and_blocks(spark):
    def text_of(name, n):
        return [body for license, body in TEMPLATES if license == name][n]

    mit, bsd2, bsd3, isc = text_of("MIT", -1), text_of("BSD-2-Clause", 0), text_of("BSD-3-Clause", -1), text_of("ISC", 0)
    prose = [(i, f"p/f{i}.txt", f"the words of this work and more {i}\n\nfor any purpose, to the people of it") for i in range(100)]

    def comment(body, mark="# "):
        words = body.split()
        return "\n".join(mark + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))

    rows = prose + [
        (200, "mit/LICENSE", "Copyright (c) 2020 Some One\n\n" + mit),
        (201, "two/LICENSE.md", "Copyright 2021, A. Body\nAll rights reserved.\n\n" + bsd2),
        (202, "three/COPYING", "Copyright 2021, A. Body\n\n" + bsd3),
        (203, "isc/LICENCE.txt", isc),
        (204, "src/a.py", "#!/bin/sh\n\n" + comment(text_of("GPL-3.0", -1)) + "\n\nimport this\nwords = 1"),
        (205, "src/b.c", comment(text_of("MPL-2.0", -1), " * ") + "\n */\n\nint main"),
        (206, "src/c.c", "x = 1\n\n" + comment(text_of("Apache-2.0", 2), "// ") + "\n\ny = 2"),
        (207, "src/d.c", comment(text_of("LGPL-2.1", 0), " * ")),
        (208, "mpl/LICENSE", "Mozilla Public License Version 2.0\n==================\n\n1. Definitions\n\n" + "many other words follow here\n" * 200),
        (209, "gpl/COPYING", "  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "many other words follow here\n" * 200),
        (210, "mit/src/x.py", "import this"),
        (211, "src/e.py", comment(text_of("MIT", -2)) + "\n#\n# The above copyright notice stays.\n\ncode = 1"),
    ]
    got = {r.doc_id: (r.own_license, r.scope, r.license, r.inherited_from) for r in report(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = {200: "MIT", 201: "BSD-2-Clause", 202: "BSD-3-Clause", 203: "ISC", 204: "GPL-3.0", 205: "MPL-2.0", 206: "Apache-2.0", 207: "LGPL-2.1", 208: "MPL-2.0", 209: "GPL-3.0", 211: "MIT"}
    assert {k: got[k][0] for k in want} == want
    # the permission paragraph is a template of its own, so a full MIT text matches by that block exactly
    assert [got[k][1] for k in (200, 201, 202, 203, 204, 205, 209)] == ["block", "file", "file", "file", "block", "block", "block"]
    assert got[210] == (None, None, "MIT", "mit")
    assert all(got[i] == (None, None, None, None) for i in range(100))
