"""License scans: TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Everything is DataFrame expressions. Terms are runs of a-z and 0-9 in lower
case; a term weighs its frequency times its inverse document frequency over the
whole corpus, in templates and texts alike. A template of L terms is compared
with windows of L terms of every text, from every term on, or for long templates
at every sixth of L. Windows know no lines, so a header counts however it is
wrapped, marked as a comment or put inside a longer line. A file named like a
licence file is also compared whole. A text that names its licence by SPDX
markers has that licence with a score of 1: a marker's expression (identifiers
joined by AND, OR and WITH, in parentheses or not) as it stands, in single
blanks and without parentheses around the whole; several different ones are
joined by AND. A marker counts if all its identifiers are known or LicenseRefs.

Most windows are never made. By Cauchy-Schwarz a window's cosine to a template
is at most the norm of the template's terms that it holds. So a template is
tried on a text only if the text holds enough of its weight, only around its
anchors (its heaviest terms, until the rest weighs less than ``least_score``),
and a window only if it holds enough itself: no window that is a multiple of the
template's step is lost by not scoring the others; what lies between two of a
long template's steps is not compared. All of that is linear in the text. Equal windows are scored once.

A file's own licence is the template of the highest cosine of ``least_score``
or more. A licence file is one named like one, or one of which a matched
licence body (a template of ``BODY`` terms or more) is ``least_share`` of its terms;
headers and markers license their own file only. Files without a licence of their own
take that of the nearest ancestor directory that has a licence file:
directories are joined with those of licence files on every ancestor path.

What reaches the driver is the document frequency of each template term, as
many rows as the templates have terms. Frequencies are counted in the tasks
before the shuffle; windows that very many files share and terms of very many
windows are spread over tasks in the joins; directories are made distinct first.

Defined results: null and blank texts have no licence of their own; files
without a path have null in all result columns; rows of an equal path are one
file, with the best of their scores; ties in the score go to the template named
first, then to the earlier window, ties between licence files of a directory to
the smaller path; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import bind, hot_keys, salted_join, settle, written

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""

#: Fixed values: (licence, text) of the templates.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Released under the ISC License."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)

LICENSE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
#: Terms from which on a template is a licence's body and not a header or title.
BODY = 60
#: Identifiers of licences and exceptions.
KNOWN = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause "
    "BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 "
    "CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only "
    "LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL NCSA OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 "
    "Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1 Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 GCC-exception-3.1 Font-exception-2.0 "
    "Linux-syscall-note LLVM-exception OpenSSL-exception"
).split()
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_ATOM = rf"(?:\([ \t]*)*{_ID}(?:[ \t]*\))*"
#: A marker; group 1 is its expression.
SPDX = rf"SPDX-License-Identifier:[ \t]*({_ATOM}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ATOM})*)"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda t: t != "")


def spdx_expressions(text: Column) -> Column:
    """The distinct SPDX expressions of a text, in order."""

    def tidy(raw: Column) -> Column:
        single = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[ \t]+", " "), r"\( ", "("), r" \)", ")")
        marks = lambda c: F.length(single) - F.length(F.replace(single, F.lit(c)))
        # a parenthesis that is not closed, or not opened, belongs to the text around
        even = F.when(marks("(") == marks(")"), single).otherwise(F.translate(single, "()", ""))
        return F.regexp_replace(even, r"^\(([^()]*)\)$", "$1")

    def fine(expression: Column) -> Column:
        ids = F.filter(F.split(F.translate(expression, "()", ""), " ", -1), lambda x: ~x.isin("AND", "OR", "WITH"))
        return F.forall(ids, lambda x: F.lower(x).isin(*(k.lower() for k in KNOWN)) | x.startswith("LicenseRef-"))

    found = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, tidy), fine))


def _together(expressions: Column) -> Column:
    """Expressions of several markers as one."""
    closed = F.transform(expressions, lambda x: F.when(x.contains(" OR ") & (F.size(expressions) > 1), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x))
    return F.array_join(closed, " AND ")


def template_terms(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def stride(length: int) -> int:
    """How far the windows of a template of ``length`` terms are apart."""
    return max(1, length // 6)


def template_frequency(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of ``files`` and, for each term of the templates, how many of them have it."""
    known = F.array(*(F.lit(t) for t in vocabulary))
    found = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", -1), known)
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("term")).groupBy("term").count().collect()
    counts = {r["term"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def other_frequency(files: DataFrame, vocabulary: list[str], needed: DataFrame) -> DataFrame:
    """In how many rows of ``files`` each needed term (term) is that the templates lack, counted in the tasks before the shuffle."""
    known = F.array(*(F.lit(t) for t in vocabulary))
    found = files.select(F.explode(F.array_except(F.split(F.lower("text"), "[^a-z0-9]+", -1), known)).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(needed, "term", "left_semi")


def template_vectors(templates, total: int, frequency: dict[str, int]) -> list[dict[str, float]]:
    """The unit vector of each template."""
    vectors = []
    for _, text in templates:
        weights = {t: n * (math.log((1 + total) / (1 + frequency.get(t, 0))) + 1) for t, n in Counter(template_terms(text)).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append({t: w / norm for t, w in weights.items()})
    return vectors


def anchors(vector: dict[str, float], least_score: float) -> list[str]:
    """Terms one of which every text of a cosine of ``least_score`` or more with the template has."""
    found, left = [], 1.0
    for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if math.sqrt(max(left, 0.0)) < least_score:
            break
        found.append(term)
        left -= w * w
    return found


def candidate_windows(words: Column, named: Column, templates: Column, vocabulary: list[str], bound: float) -> Column:
    """Windows (k, at, words) that hold ``bound`` of the squared weight of template k; ``at`` is -1 for a whole file."""

    def mass(held: Column, t: Column) -> Column:
        return F.aggregate(F.filter(t["terms"], lambda x: F.array_contains(held, x["term"])), F.lit(0.0), lambda a, x: a + x["w"])

    def unit(t: Column, at: Column, held: Column) -> Column:
        return F.struct(t["k"].alias("k"), at.alias("at"), held.alias("words"))

    def windows(t: Column, every: Column) -> Column:
        places = F.filter(F.transform(every, lambda w, i: F.when(F.array_contains(t["anchors"], w), i)), lambda i: i.isNotNull())
        step, size = t["stride"], t["size"]
        around = F.transform(places, lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")), lambda j: (F.floor(i / step).cast("int") - j) * step), lambda s: (s >= 0) & (s > i - size)))
        made = F.transform(F.array_distinct(F.flatten(around)), lambda s: unit(t, s, F.slice(every, s + 1, size)))
        kept = F.filter(made, lambda u: mass(u["words"], t) >= bound)
        return F.concat(kept, F.filter(F.array(unit(t, F.lit(-1), every)), lambda _: named))

    def tried(every: Column) -> Column:
        held = F.array_intersect(every, F.array(*(F.lit(t) for t in vocabulary)))
        fits = bind(held, lambda h: F.filter(F.filter(templates, lambda t: F.arrays_overlap(h, t["anchors"])), lambda t: mass(h, t) >= bound))
        return F.flatten(F.transform(fits, lambda t: windows(t, every)))

    return bind(words, tried)


def own_licenses(files: DataFrame, templates=TEMPLATES, least_score: float = 0.75) -> DataFrame:
    """path, own_license, own_score, share for each path with a licence of its own.

    ``share`` is the matched licence body's part of the file's terms, 0 where no body matched.
    """
    vocabulary = sorted({t for _, text in templates for t in template_terms(text)})
    total, known = template_frequency(files, vocabulary)
    vectors = template_vectors(templates, total, known)
    sizes = [len(template_terms(text)) for _, text in templates]
    listed = [
        {"k": k, "size": n, "stride": stride(n), "anchors": anchors(v, least_score), "terms": [{"term": t, "w": w * w} for t, w in sorted(v.items())]}
        for k, (n, v) in enumerate(zip(sizes, vectors, strict=True))
    ]
    literal = F.from_json(F.lit(json.dumps(listed)), "array<struct<k:int,size:int,stride:int,anchors:array<string>,terms:array<struct<term:string,w:double>>>>")
    every_anchor = sorted({t for x in listed for t in x["anchors"]})
    words = terms(F.col("text"))
    bound = least_score * least_score * (1 - 1e-9)
    named = F.col("path").rlike(LICENSE_FILE)
    held = files.where(F.col("path").isNotNull() & F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+", -1), F.array(*(F.lit(t) for t in every_anchor))))
    found = held.select("path", F.xxhash64("text").alias("text_id"), F.size(words).alias("all"), candidate_windows(words, named, literal, vocabulary, bound).alias("found"))
    units = found.select("path", "text_id", "all", F.explode("found").alias("u")).select("path", "text_id", "all", "u.k", "u.at", F.size("u.words").alias("size"), F.array_join("u.words", " ").alias("words")).withColumn("unit", F.md5("words"))
    # equal windows of a file are one, and equal windows of all files are scored once
    units = written(units.groupBy("path", "text_id", "all", "k", "size", "unit").agg(F.min("at").alias("at"), F.first("words").alias("words")), "windows")
    texts = units.groupBy("k", "unit").agg(F.first("words").alias("words"))
    counted = texts.select("k", "unit", F.explode(F.split("words", " ")).alias("term")).groupBy("k", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = written(counted, "terms")
    units = units.drop("words")
    plain = counted.select("term").distinct().where(~F.col("term").isin(*vocabulary))
    of_templates = files.sparkSession.createDataFrame([(t, known.get(t, 0)) for t in vocabulary], "term string, df long")
    frequency = settle(other_frequency(files, vocabulary, plain)).unionByName(of_templates)
    postings = files.sparkSession.createDataFrame([(k, t, w) for k, v in enumerate(vectors) for t, w in v.items()], "k int, term string, weight double")
    x = F.col("tf") * (F.log((F.lit(1.0) + total) / (F.lit(1) + F.col("df"))) + 1)
    scores = (
        salted_join(counted, frequency, ["term"], hot_keys(counted, ["term"]), ["unit"])
        .join(F.broadcast(postings), ["k", "term"], "left")  # as many rows as the templates have terms
        .groupBy("k", "unit")
        .agg(F.round(F.sum(x * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(x * x)), 12).alias("score"))
        .where(F.col("score") >= least_score)
    )
    names = F.array(*(F.lit(name) for name, _ in templates))
    bodies = F.array(*(F.lit(n >= BODY) for n in sizes))
    scored = salted_join(units, scores, ["k", "unit"], hot_keys(units, ["k", "unit"]), ["path"]).select(
        "path", "score", "k", "at", F.element_at(names, F.col("k") + 1).alias("name"), F.when(F.get(bodies, F.col("k")), F.col("size") / F.col("all")).otherwise(F.lit(0.0)).alias("share")
    )
    stated = spdx_expressions(F.col("text"))
    said = files.where(F.col("path").isNotNull() & F.col("text").contains("SPDX-License-Identifier:")).select(
        "path", F.lit(1.0).alias("score"), F.lit(-1).alias("k"), F.lit(0).alias("at"), bind(stated, _together).alias("name"), F.lit(0.0).alias("share")
    )
    rows = scored.unionByName(said.where("name <> ''"))
    best = F.struct("score", (-F.col("k")).alias("order"), (-F.col("at")).alias("place"), "name", "share")
    return rows.groupBy("path").agg(F.max(best).alias("x")).select("path", F.col("x.name").alias("own_license"), F.col("x.score").alias("own_score"), F.col("x.share").alias("share"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(paths: DataFrame, own: DataFrame, least_share: float = 0.5) -> DataFrame:
    """path, license, license_dir: for each distinct path its own licence (license_dir null) or the nearest ancestor's."""
    grants = (
        own.where(F.col("path").rlike(LICENSE_FILE) | (F.col("share") >= least_share))
        .groupBy(_directory(F.col("path")).alias("ancestor"))
        .agg(F.min_by("own_license", F.struct((-F.col("own_score")).alias("s"), "path")).alias("granted"))
    )
    files = paths.where("path is not null").distinct().withColumn("dir", _directory(F.col("path")))
    parts = F.split("dir", "/", -1)
    chain = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))
    nearest = (
        files.select("dir")
        .distinct()
        .select("dir", F.explode(chain).alias("c"))
        .select("dir", "c.depth", "c.ancestor")
        .join(grants, "ancestor")
        .groupBy("dir")
        .agg(F.max_by(F.struct("granted", "ancestor"), "depth").alias("g"))
    )
    return (
        files.join(own, "path", "left")
        .join(nearest, "dir", "left")
        .select(
            "path",
            "own_license",
            "own_score",
            F.coalesce("own_license", "g.granted").alias("license"),
            F.when(F.col("own_license").isNull(), F.col("g.ancestor")).alias("license_dir"),
        )
    )


def scan(files: DataFrame, templates=TEMPLATES, least_score: float = 0.75, least_share: float = 0.5) -> DataFrame:
    """path, own_license, own_score, license, license_dir for each distinct path of ``files`` (path, text)."""
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return inherit(rows.select("path"), own_licenses(rows, templates, least_score), least_share)
