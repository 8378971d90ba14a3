"""License scans against a plain Python version, and edge cases."""

import math
import re
import time
from collections import Counter

import pytest

from docweft.llm import licenses as lic

SCHEMA = "path string, text string, license string, all int"


def plain(files, least_score=0.75, least_share=0.5):
    def words(t):
        return re.findall("[a-z0-9]+", t.lower())

    df = Counter(w for _, t in files for w in set(words(t or "")))

    def cosine(a, b):
        va, vb = ({w: n * (math.log((1 + len(files)) / (1 + df[w])) + 1) for w, n in Counter(x).items()} for x in (a, b))
        dot = sum(x * vb.get(w, 0) for w, x in va.items())
        return dot / math.sqrt(sum(x * x for x in va.values())) / math.sqrt(sum(x * x for x in vb.values())) if va else 0

    own = {}

    def offer(path, mark, name, share):
        if path is not None and (path not in own or mark > own[path][0]):
            own[path] = (mark, name, share)

    for path, text in files:
        own_words = words(text or "")
        if path is not None and (said := re.search("SPDX-License-Identifier:[ \\t]*([A-Za-z0-9.+-]+)", text or "")):
            offer(path, (1.0, 1, 0), said[1], 0)
        for k, (name, template) in enumerate(lic.TEMPLATES):
            t = words(template)
            units = [(at, own_words[at : at + len(t)]) for at in range(0, len(own_words), lic.stride(len(t)))]
            units = [(at, unit) for at, unit in units if set(unit) & set(t)]
            if re.search(lic.LICENSE_FILE, path or ""):
                units.append((-1, own_words))
            for at, unit in units:
                score = cosine(unit, t)
                if score >= least_score:
                    offer(path, (round(score, 9), -k, -at), name, len(unit) / len(own_words) if len(t) >= lic.BODY else 0)
    grants = {}
    for path, (mark, name, share) in own.items():
        if re.search(lic.LICENSE_FILE, path) or share >= least_share:
            where = path.rpartition("/")[0]
            grants[where] = min(grants.get(where, ((9,), None)), ((-mark[0], path), name))
    out = {}
    for path in {p for p, _ in files if p is not None}:
        if path in own:
            out[path] = (own[path][1], None, own[path][0][0])
            continue
        at = path.rpartition("/")[0]
        while at and at not in grants:
            at = at.rpartition("/")[0]
        out[path] = (grants[at][1], at, None) if at in grants else (None, None, None)
    return out


FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software\nwithout restriction"),
    ("a/main.py", "x = 1\nprint(x)"),
    ("a/b/c/deep.py", "y = 2"),
    ("a/b/own.py", "# Licensed under the Apache License, Version 2.0.\nz = 3\nfor k in range(10):\n    print(k, z, \"more code than notice\")"),
    ("a/b2/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b2/x/y/z.c", "int main;"),
    ("top.txt", "nothing of the kind"),
    ("q/notes", "Licensed under CC BY-NC 4.0."),
    ("q/r/notes", "Some licensed words that are about the general public and a version of it"),
    ("w/none", None),
    ("w/blank", ""),
    (None, "Released under the MIT License."),
    ("e/dup", "Released under the MIT License."),
    ("e/dup", "Released under the MIT License."),
    ("e/LICENSE-2", "Released under the ISC License."),
    ("e/other", "text"),
    ("s/spdx.py", "# SPDX-License-Identifier: EPL-2.0\nx = 1"),
    ("f/LICENSE", "Copyright 2020 Somebody\n\n" + lic._MIT),
    ("f/wrapped.c", "/*\n * " + "\n * ".join(re.findall(r"(?:\S+\s*){1,3}", lic._APACHE)) + "\n */\nint main() { return 0; }"),
    ("f/inline.txt", " ".join(f"word{k}" for k in range(100)) + " Released under the MIT License. " + " ".join(f"more{k}" for k in range(100))),
    ("g/tiny.py", "# SPDX-License-Identifier: MIT\nx = 1"),
    ("g/h/other.py", "y = 2"),
    ("f/bsd2", lic._BSD_HEAD + "\n" + lic._BSD_TAIL),
    ("long/file", "filler words\n" * 2_000 + "Licensed under CC BY 4.0.\n" + "more " * 1000),
]


def test_against_plain_python(spark):
    files = spark.createDataFrame([(p, t, "clash", 1) for p, t in FILES], SCHEMA).repartition(3)
    got = {r.path: (r.license, r.license_dir, r.own_score) for r in lic.scan(files).collect()}
    want = plain(FILES)
    assert {p: x[:2] for p, x in got.items()} == {p: x[:2] for p, x in want.items()}
    for p, (_, _, score) in got.items():
        assert (score is None) == (want[p][2] is None) and (score is None or score == pytest.approx(want[p][2], abs=1e-6))
    assert got["a/b/c/deep.py"][:2] == ("MIT", "a") and got["a/b2/x/y/z.c"][:2] == ("GPL-3.0", "a/b2") and got["top.txt"][0] is None


def test_many_anchor_lines(spark):
    """10,000 lines of anchors, and 10,000 copies of a header, in one file each."""
    many = "\n".join(f"software license public {k % 90}" for k in range(10_000))
    header = "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.\n" * 10_000
    others = [(f"c/{k}", f"text {k}", "", 1) for k in range(20)]
    began = time.perf_counter()
    assert lic.scan(spark.createDataFrame([("a/notice", many, "", 1), *others], SCHEMA)).where("license is not null").count() == 0
    assert time.perf_counter() - began < 20
    got = lic.scan(spark.createDataFrame([("b/x", header, "", 1), *others], SCHEMA)).where("license is not null").collect()
    assert [(r.path, r.license) for r in got] == [("b/x", "Apache-2.0")]


def test_empty(spark):
    assert lic.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spdx_expressions(spark):
    """Whole expressions, several markers, unknown names, parentheses of the text around."""
    mark = "SPDX-License-Identifier: "
    texts = {
        f"// {mark}(GPL-2.0 OR MIT)\ncode": "GPL-2.0 OR MIT",
        f"{mark}MIT OR Apache-2.0 */": "MIT OR Apache-2.0",
        f"{mark}GPL-2.0-only  WITH\tClasspath-exception-2.0 -->": "GPL-2.0-only WITH Classpath-exception-2.0",
        f"{mark}( MIT AND ( ISC OR Zlib ) ) and more": "(MIT AND (ISC OR Zlib))",
        f"(see {mark}MIT)": "MIT",
        f"{mark}MIT.\n{mark}ISC OR Zlib\n{mark}MIT": "MIT AND (ISC OR Zlib)",
        f"{mark}LicenseRef-Own AND MIT": "LicenseRef-Own AND MIT",
        f"{mark}<the identifier>": None,
        f"{mark}Nonsense-1.0": None,
        f"{mark}mit OR": "mit",
    }
    files = spark.createDataFrame([(f"d{k}/f", t, "", 1) for k, t in enumerate(texts)] + [(f"d{k}/sub/other", "nothing", "", 1) for k in range(len(texts))], SCHEMA)
    got = {r.path: r.license for r in lic.scan(files).collect()}
    assert [got[f"d{k}/f"] for k in range(len(texts))] == list(texts.values())
    assert not any(got[f"d{k}/sub/other"] for k in range(len(texts)))


def test_markers_grant_in_licence_files_alone(spark):
    rows = [("a/LICENSE", "SPDX-License-Identifier: MIT"), ("a/x/f", "code"), ("b/tiny", "Released under the MIT License."), ("b/x/f", "code"), ("c/notes", lic._MIT), ("c/x/f", "code")]
    got = {r.path: (r.license, r.license_dir) for r in lic.scan(spark.createDataFrame([(p, t, "", 1) for p, t in rows], SCHEMA)).collect()}
    assert got["a/x/f"] == ("MIT", "a") and got["b/x/f"] == (None, None) and got["c/x/f"] == ("MIT", "c") and got["b/tiny"] == ("MIT", None)
