"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest directory.

Lines, header blocks (runs of lines that hold a term) and whole licence files are sparse vectors of
their terms, weighted by document frequency over all texts, and compared with statements, standard
headers and full licence texts. Texts are tokenised once. A vector is compared only with templates
that an exact upper bound of the cosine lets pass. Files that are licences speak for their
directory; a file without a statement of its own inherits from the nearest directory above it.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import lookup, new_folder, stored

#: Licence statements, headers and texts by SPDX name: fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at""",
    ),
    (
        "Apache-2.0",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    ),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""",
    ),
    (
        "LGPL-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version.""",
    ),
    (
        "AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:""",
    ),
    (
        "MIT",
        """MIT License

        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.

        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
        or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
]
#: Least cosine of a line, block or licence file to a template.
THRESHOLD = 0.8
#: File names, in lower case, that speak for their directory.
LICENSE_FILE = r"^(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
#: What a statement was found in.
SCOPES = ["line", "block", "file"]


def terms_of(text: Column) -> Column:
    """Lower-case terms: runs of letters, digits, dots and hyphens, without dots or hyphens at the ends."""
    trimmed = F.regexp_replace(F.lower(text), r"[.\-]++(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.\-])[.\-]++", " ")
    return F.filter(F.split(trimmed, r"[^\p{L}\p{N}.\-]+"), lambda t: t != "")


def _template_terms(templates: list[tuple[str, str]]) -> list[tuple[str, dict[str, int]]]:
    out = []
    for name, text in templates:
        counts: dict[str, int] = {}
        for term in re.split(r"[^\w.\-]+", text.lower()):
            if term := term.strip(".-"):
                counts[term] = counts.get(term, 0) + 1
        out.append((name, counts))
    return out


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """The stored table (term, n): in how many rows of a table with `lines` (lists of terms) each term occurs.

    A task counts its rows' distinct terms before the shuffle, so a term that every text has is one
    row per task.
    """
    each = tokens.select(F.explode(F.array_distinct(F.flatten("lines"))).alias("term"))
    return stored(each.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "frequencies")


def weigh(told: list[tuple[str, dict[str, int]]], n: int, frequencies: dict[str, int], threshold: float) -> list[dict]:
    """Each template with its weighted terms, its length, and its anchors.

    A vector without any anchor shares too little of the template to reach the threshold: by Cauchy's
    inequality the cosine is at most the length of the shared part over the whole length. Anchors are
    the rarest terms that leave less than that outside.
    """
    out = []
    for i, (name, counts) in enumerate(told):
        entries = [{"term": t, "idf": math.log((1 + n) / (1 + frequencies.get(t, 0))) + 1} for t in counts]
        for e in entries:
            e["weight"] = counts[e["term"]] * e["idf"]
        total = sum(e["weight"] ** 2 for e in entries)
        anchors, outside = [], 0.0
        for e in sorted(entries, key=lambda e: (e["idf"], e["term"])):
            if anchors or outside + e["weight"] ** 2 >= (threshold - 1e-6) ** 2 * total:
                anchors.append(e["term"])
            else:
                outside += e["weight"] ** 2
        out.append({"template": i, "license": name, "length": math.sqrt(total), "anchors": anchors, "entries": entries})
    return out


TEMPLATE_TYPE = "array<struct<template int, length double, anchors array<string>, entries array<struct<term string, idf double, weight double>>>>"


def open_units(lines: Column, whole: Column, weighed: list[dict], threshold: float) -> Column:
    """(line, scope, terms, templates) for what can reach the threshold with some template, and with which.

    Lines, blocks of two or more lines that hold a term each and, where `whole`, all lines together.
    The dot product with a template is exact; the vector's length is bounded from below, each term
    outside the template weighing 1 at least.
    """
    templates = F.from_json(F.lit(json.dumps(weighed)), TEMPLATE_TYPE)
    anchors = F.array(*[F.lit(t) for t in sorted({t for w in weighed for t in w["anchors"]})])

    def reaches(terms: Column, t: Column) -> Column:
        tallies = F.transform(
            t["entries"], lambda e: F.struct(F.size(F.filter(terms, lambda x: x == e["term"])).alias("tf"), e["idf"].alias("idf"), e["weight"].alias("weight"))
        )
        zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("own"), F.lit(0).alias("inside"))
        return F.aggregate(
            tallies, zero,
            lambda a, x: F.struct(
                (a["dot"] + x["tf"] * x["idf"] * x["weight"]).alias("dot"), (a["own"] + x["tf"] * x["tf"] * x["idf"] * x["idf"]).alias("own"),
                (a["inside"] + x["tf"]).alias("inside"),
            ),
            lambda a: a["dot"] >= (threshold - 1e-6) * t["length"] * F.sqrt(a["own"] + F.size(terms) - a["inside"]),
        )

    def unit(line: Column, scope: int, terms: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), F.lit(scope).alias("scope"), terms.alias("terms"))

    def able(u: Column) -> Column:
        near = F.filter(templates, lambda t: F.arrays_overlap(u["terms"], t["anchors"]) & reaches(u["terms"], t))
        return F.struct(u["line"].alias("line"), u["scope"].alias("scope"), u["terms"].alias("terms"), F.transform(near, lambda t: t["template"]).alias("templates"))

    blanks = F.filter(F.transform(lines, lambda body, i: F.when(F.size(body) == 0, i)), lambda i: i.isNotNull())
    starts, ends = F.concat(F.array(F.lit(-1)), blanks), F.concat(blanks, F.array(F.size(lines)))
    spans = F.filter(
        F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("at"), (b - a - 1).alias("count"))), lambda s: s["count"] > 1
    )
    units = F.concat(
        F.transform(lines, lambda body, i: unit(i, 0, body)),
        F.transform(spans, lambda s: unit(s["at"], 1, F.flatten(F.slice(lines, s["at"] + 1, s["count"])))),
        F.when(whole & (F.size(lines) > 1), F.array(unit(F.lit(0), 2, F.flatten(lines)))).otherwise(F.array()),
    )
    return F.filter(F.transform(F.filter(units, lambda u: F.arrays_overlap(u["terms"], anchors)), able), lambda u: F.size(u["templates"]) > 0)


def statements(held: DataFrame, weighed: list[dict], idf: DataFrame, threshold: float) -> DataFrame:
    """(row, license, similarity, line, scope): the best statement of each row of a stored table (row, open units).

    `idf` (term, idf) has every term of every text. Of equal similarities (to six digits) the earlier
    line wins, then the line before the block before the file, then the template that comes first.
    """
    spark = held.sparkSession
    units = held.select("row", F.posexplode("open").alias("unit", "u")).select("row", "unit", "u.*")
    entries = [(w["template"], e["term"], e["weight"]) for w in weighed for e in w["entries"]]
    template_rows = spark.createDataFrame(entries, "template int, term string, weight double")
    lengths = [(w["template"], w["length"], w["license"]) for w in weighed]
    template_lengths = spark.createDataFrame(lengths, "template int, length double, license string")
    # the sparse vector of each open unit: its terms with their counts; template tables are fixed and small
    vectors = units.select("row", "unit", F.explode("terms").alias("term")).groupBy("row", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = lookup(vectors, idf, "term", ["row", "unit"]).withColumn("mine", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("mine") * F.col("mine"))).alias("norm"))
    able = units.select("row", "unit", "line", "scope", F.explode("templates").alias("template"))
    dots = (
        weighted.join(F.broadcast(template_rows), "term")
        .groupBy("row", "unit", "template")
        .agg(F.sum(F.col("mine") * F.col("weight")).alias("dot"))
        .join(able, ["row", "unit", "template"])
    )
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6)
    close = dots.join(norms, ["row", "unit"]).join(F.broadcast(template_lengths), "template")
    close = close.withColumn("similarity", cosine).where(F.col("similarity") >= threshold)
    best = close.groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "line", "scope", "template", "license")).alias("b"))
    named = F.element_at(F.array(*[F.lit(s) for s in SCOPES]), F.col("b.scope") + 1)
    return best.select("row", "b.license", (-F.col("b.far")).alias("similarity"), "b.line", named.alias("scope"))


def directory_of(path: Column) -> Column:
    """The directory of a path, without a slash at its end; of a file at the top, the empty text."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"/+$", "")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, nearest first, down to the empty top."""
    steps = F.filter(F.split(directory, "/"), lambda s: s != "")
    count = F.size(steps)
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.array_join(F.slice(steps, F.lit(1), count - i), "/"))


def report(
    files: DataFrame, id_col: str = "doc_id", path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of `files`: (id, path, own_license, similarity, line, scope, license, inherited_from).

    `own_license` is the closest template of any line, header block or, in files named like
    licences, of the whole text; `scope` says which of the three and `line` where it starts. `license` is
    the file's own statement, or that of the nearest directory at or above its own that
    holds a licence file with a statement (of several, the smallest path's, then the smallest
    name's); `inherited_from` is that directory, null for own statements. Null texts state nothing;
    null paths inherit nothing. Ids may be null or repeated. Other columns and their names play no
    part. An empty table gives an empty one.
    """
    told = _template_terms(templates)
    spark = files.sparkSession
    base = files.select(F.col(id_col).alias("id"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tokens = base.select(
        F.monotonically_increasing_id().alias("row"), "id", "path", directory_of(F.col("path")).alias("dir"),
        F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name"), F.transform(F.split("text", "\n"), terms_of).alias("lines"),
    )
    folder = new_folder(spark, "tokens")
    tokens.write.option("compression", "zstd").parquet(folder)  # as long as the texts, so packed tighter than the other tables
    tokens = spark.read.schema(tokens.schema).parquet(folder)
    n = tokens.count()
    frequencies = document_frequencies(tokens)
    vocabulary = sorted({t for _, counts in told for t in counts})
    counts = {r.term: r.n for r in frequencies.where(F.col("term").isin(vocabulary)).collect()}
    weighed = weigh(told, n, counts, threshold)
    idf = frequencies.select("term", (F.log(F.lit(1.0 + n) / (F.col("n") + 1)) + 1).alias("idf"))
    speaks = F.coalesce(F.col("name").rlike(LICENSE_FILE), F.lit(False))
    listed = stored(tokens.select("row", "id", "path", "dir", "name", open_units(F.col("lines"), speaks, weighed, threshold).alias("open")), "files")
    found = stored(statements(listed, weighed, idf, threshold), "statements")
    placed = listed.drop("open").join(found, "row", "left")
    speak = placed.where(F.col("license").isNotNull() & speaks)
    speaking = stored(
        speak.groupBy(F.array_join(F.filter(F.split("dir", "/"), lambda s: s != ""), "/").alias("at")).agg(F.min(F.struct("path", "license")).alias("first")), "speaking"
    )
    directories = listed.where(F.col("path").isNotNull()).select("dir").distinct()
    chain = directories.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "at"))
    pairs = lookup(chain, speaking, "at", ["dir"]).where(F.col("first").isNotNull())
    nearest = stored(pairs.groupBy("dir").agg(F.min(F.struct("up", "at", F.col("first.license").alias("license"))).alias("from")), "nearest")
    return lookup(placed, nearest, "dir", ["row"]).select(
        F.col("id").alias(id_col), F.col("path").alias(path), F.col("license").alias("own_license"), "similarity", "line", "scope",
        F.coalesce("license", "from.license").alias("license"),
        F.when(F.col("license").isNull(), F.col("from.at")).alias("inherited_from"),
    )
