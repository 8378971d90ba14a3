"""Line dedup against brute force, after every step of insertions and deletions, and the filters by themselves."""

import random

import numpy as np
import pytest

from docweft.llm import linededup
from docweft.llm.cuckoo import Cuckoo

SCHEMA = "doc_id long, text string, kept_text string, __own0 string, line string"


def rows_of(docs):
    return [(i, t, "clash", "c", "l") for i, t in docs]


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(index, docs, least_chars, least_docs):
    """(id, lines before, dropped, text after) of docs against an index of documents."""
    held = {}
    for i, t in index:
        for line in (t or "").split("\n") if i is not None else []:
            if len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [i is not None and len(held.get(key(x), ())) >= least_docs and max(held[key(x)]) != i for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def cleaned(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in frame.collect()), key=repr)


def make(rng, ids):
    pool = ["A line that is long enough %d" % k for k in range(12)] + ["short", "", "  \t", "É line with Ünicode letters", "é line with Ünicode letters", "𝔘nicode beyond the plane!!"]
    pad = lambda x: rng.choice(["", " ", "\t\x0b"]) + rng.choice([x, x.upper(), x.lower()]) + rng.choice(["", "  ", "\r"])
    return [(i, rng.choice([None, ""]) if rng.random() < 0.1 else "\n".join(pad(rng.choice(pool)) for _ in range(rng.randint(1, 8)))) for i in ids]


def test_insert_delete_and_clean(spark):
    rng = random.Random(5)
    docs = make(rng, [*range(30), None, None])
    frame = lambda some: spark.createDataFrame(rows_of(some), SCHEMA)
    index = linededup.LineIndex(spark, None, 20, 3, shards=4)
    live = docs[:20]
    index.insert(frame(live))
    assert cleaned(index.clean(frame(docs))) == brute(live, docs, 20, 3)
    index.insert(frame(docs[20:]))
    live = docs
    assert cleaned(index.clean(frame(docs))) == brute(live, docs, 20, 3)
    gone = rng.sample(range(30), 16)
    index.delete(spark.createDataFrame([(i,) for i in [*gone, 999]] + [(None,)], "doc_id long"))
    live = [d for d in docs if d[0] not in gone]
    assert cleaned(index.clean(frame(docs))) == brute(live, docs, 20, 3)
    counted = {(r.k1, r.k2): (r.refs, r.top) for r in index.counts().where("refs > 0").collect()}
    held = {}
    for r in index.postings().collect():
        held.setdefault((r.k1, r.k2), set()).add(r.doc_id)
    assert counted == {k: (len(v), max(v)) for k, v in held.items()}
    back = [d for d in docs if d[0] in gone[:5]]
    again = linededup.LineIndex.open(spark, index.path).insert(frame(back))
    live += back
    assert cleaned(again.clean(frame(docs))) == brute(live, docs, 20, 3)
    assert cleaned(again.rebuild().clean(frame(docs))) == brute(live, docs, 20, 3)
    with pytest.raises(ValueError, match="already"):
        again.insert(frame(back))


def test_hot_lines_and_repeated_rows(spark, monkeypatch):
    """Keys over the share of hot ones, whole documents twice, an id with two texts, all lines dropped."""
    monkeypatch.setattr(linededup, "HOT_LEAST", 5)
    common = "This line stands in every document"
    docs = [(i, f"{common}\nown line number {i} of this document\n{common}") for i in range(40)] + [(3, "another text of that id\n" + common), (7, f"{common}\nown line number 7 of this document\n{common}"), (8, common)]
    out = linededup.LineIndex(spark, None, 20, 3, shards=2).insert(spark.createDataFrame(rows_of(docs), SCHEMA)).clean(spark.createDataFrame(rows_of(docs), SCHEMA))
    assert cleaned(out) == brute(docs, docs, 20, 3)
    assert sorted(out.columns) == sorted(["doc_id", "text", "kept_text", "__own0", "line", "n_lines", "n_dropped"])


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert linededup.LineIndex(spark, None, 20, 3, shards=2).insert(empty).clean(empty).count() == 0
    long = "\n".join(f"line {k % 30_000} of a very long text" for k in range(50_000)) + "\n" + "x" * 1_000_000
    docs = [(i, long) for i in range(3)]
    out = linededup.LineIndex(spark, None, 20, 3, shards=2).insert(spark.createDataFrame(rows_of(docs), SCHEMA)).clean(spark.createDataFrame(rows_of(docs), SCHEMA))
    assert [(i, n, d) for i, n, d, _ in cleaned(out)] == [(0, 50_001, 50_001), (1, 50_001, 50_001), (2, 50_001, 0)]


def test_filters_forget_nothing():
    """Insertions and removals beyond a filter's room: what is held is found, what the stash took too; few others are."""
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, (6000, 2))
    cells = Cuckoo.sized(1000)
    cells.insert(keys[:3000, 0], keys[:3000, 1])
    assert len(cells.stash) > 0 and cells.holds(keys[:3000, 0], keys[:3000, 1]).all()
    cells.remove(keys[:2000, 0], keys[:2000, 1])
    assert cells.holds(keys[2000:3000, 0], keys[2000:3000, 1]).all()
    cells = Cuckoo.from_bytes(*cells.to_bytes())
    assert cells.holds(keys[2000:3000, 0], keys[2000:3000, 1]).all()
    assert cells.holds(keys[3000:, 0], keys[3000:, 1]).mean() < 0.01
    same = np.full(30, 7, np.int64)
    cells = Cuckoo.sized(64)
    cells.insert(same, same)
    cells.remove(same[:25], same[:25])
    assert cells.holds(same[:1], same[:1]).all()
