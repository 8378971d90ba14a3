"""Label search against a plain version of the rule, and how long documents fare."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from docweft.functions import labels as L
from docweft.functions.text import WHITE
from docweft.operators import assemble
from docweft.operators.extract import Matched, extract
from docweft.plans import engine
from docweft.schema import FieldSpec, SchemaSpec

DOC = "doc_id string, texts array<array<string>>"


def documents(spark, rows):
    """Documents of (id, pages of block texts)."""
    df = spark.createDataFrame(rows, DOC)
    pages = assemble.pages_from_texts(F.col("doc_id"), F.col("texts"), "native_text")
    none = F.lit(None).cast("string")
    return df.select(*assemble.document(F.col("doc_id"), F.lit("text"), pages, none, none, {}))


def values(text, label):
    """The rule in its plain form, with steps back."""
    s = f"[{WHITE}]*"
    found = re.findall(rf"(?m)^{s}(?:[-*•]{s})?{re.escape(label)}{s}[:：]{s}([^\n\r]+)$", text)
    return [v.strip(WHITE) for v in found if v.strip(WHITE)]


def first_of_each(found):
    """Values that don't differ in case alone."""
    return [v for k, v in enumerate(found) if v.lower() not in [w.lower() for w in found[:k]]]


def plain_leaf(pages, labels):
    """Values and evidence blocks of a leaf by comparing every value with every block."""
    blocks = [b for p in pages for b in p]
    text = "\n".join(b.strip(WHITE) for b in blocks if b.strip(WHITE))
    found, evidence = [], []
    for label in labels:
        for v in dict.fromkeys(values(text, label)):
            found.append(v)
            evidence += [k for k, b in enumerate(blocks) if label in b and v in b]
        for k, b in enumerate(blocks):
            for v in first_of_each(values(b, label)):
                found.append(v)
                evidence.append(k)
    return found, list(dict.fromkeys(evidence))


def make(rng):
    """Pages of blocks full of labels, bullets, blank lines, carriage returns and values that hold one another."""
    piece = lambda: rng.choice(["a: x", "a:", "a", ": y", "- a: x1", "*  a ： x12", "b: a: q", "b:\t12", "aa: z", "-", "", " ", "x1", "a: v\r", "A: V", "a: \u3000w", "b: 1", "see a x", "b: 12 ", "a:\n\nx"])
    return [["\n".join(piece() for _ in range(rng.randint(1, 4))).strip(WHITE) or "k" for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]


def test_search_against_the_plain_rule(monkeypatch):
    for few in (0, 64):
        monkeypatch.setattr(L, "FEW", few)
        rng = random.Random(few)
        for _ in range(1500):
            pages = make(rng)
            blocks = [(n, b) for n, p in enumerate(pages, 1) for b in p]
            text = "\n".join(b.strip(WHITE) for _, b in blocks if b.strip(WHITE))
            for names in (["a"], ["b", "a"], ["aa"]):
                found, evidence = L.leaf_matches([text], [n for n, _ in blocks], [b for _, b in blocks], names)
                want, which = plain_leaf(pages, names)
                assert [v for _, v in found] == want and list(evidence) == which, (pages, names)


def test_pages_against_every_prefix():
    """What the pages up to any one give is what a document of these pages gives."""
    rng = random.Random(7)
    for _ in range(1500):
        pages = make(rng)
        texts = ["\n".join(b.strip(WHITE) for b in p if b.strip(WHITE)) for p in pages]
        blocks = [(n, b) for n, p in enumerate(pages, 1) for b in p]
        for names in (["a"], ["b", "a"], ["x1", "aa"]):
            found, evidence = L.leaf_matches(texts, [n for n, _ in blocks], [b for _, b in blocks], names)
            for upto in range(1, len(pages) + 1):
                want, which = plain_leaf(pages[:upto], names)
                assert list(dict.fromkeys(v for p, v in found if p <= upto)) == list(dict.fromkeys(want)), (pages, upto, names)
                assert {b for b, p in evidence.items() if p <= upto} == set(which)


def test_fields_of_prefixes(spark):
    """changes_by_page beside extractions of each prefix as a document of its own."""
    rng = random.Random(3)
    rows = [(str(i), make(rng)) for i in range(40)]
    schema = SchemaSpec("s", "1", (FieldSpec("a", multiple=True), FieldSpec("b", "number", required=True), FieldSpec("o", "array", children=(FieldSpec("a", multiple=True), FieldSpec("b", "number", multiple=True)))))
    matched = Matched(documents(spark, rows), schema, by_page=True)
    got = {}
    for r in matched.changes_by_page().collect():
        got[(r.doc_id, r.n, r.prefix_pages)] = (r.f.value_json, r.f.confidence, sorted(e.text for e in r.f.evidences), len(r.new))
    prefixes = [(f"{i}|{n}", pages[:n]) for i, pages in rows for n in range(1, len(pages) + 1)]
    checked = 0
    for r in extract(documents(spark, prefixes), schema).collect():
        i, n = r.doc_id.split("|")
        for k, f in enumerate(r.fields):
            last = max(p for (d, x, p) in got if d == i and x == k and p <= int(n))
            assert got[(i, k, last)][:3] == (f.value_json, f.confidence, sorted(e.text for e in f.evidences))
            checked += 1
    assert checked > 300


def test_long_documents(spark):
    """100,000 labelled lines in one block, 10,000 blocks with a value each, values that hold one another."""
    spec = SchemaSpec("s", "1", (FieldSpec("lines", "array", children=(FieldSpec("part", "number", multiple=True),)),))
    began = time.perf_counter()
    rows = [("one block", [["\n".join(f"* part: {k}" for k in range(100_000))]]), ("blocks", [[f"part: {k}" for k in range(10_000)]])]
    out = {r.doc_id: r.fields[0] for r in engine._results(documents(spark, rows), spec, engine.EngineConfig(return_evidence=True)).collect()}
    assert len(json.loads(out["one block"].value_json)) == 100_000 and len(out["one block"].evidences) == 1
    assert len(json.loads(out["blocks"].value_json)) == 10_000 and len(out["blocks"].evidences) == 10_000
    assert time.perf_counter() - began < 60


def test_blank_lines_are_linear():
    began = time.perf_counter()
    for text in ("\n" * 300_000 + "a: x", "a:" + " " * 300_000 + "x\r", ("-" + "\n" * 100) * 3000, "a\n" * 200_000):
        L.leaf_matches([text], [1], [text], ["a"])
    assert time.perf_counter() - began < 10


def test_two_thousand_pages(spark):
    """Events of a document of 2,000 pages: each page adds a value, and each third a value it shares."""
    rows = [("d", [[f"k: v{n}", "m: 1" if n % 3 else f"m: {n}"] for n in range(2000)])]
    docs = documents(spark, rows)
    schema = SchemaSpec("s", "1", (FieldSpec("k", multiple=True), FieldSpec("m", "number")))
    began = time.perf_counter()
    from docweft.functions.shared import settle
    from docweft.operators.incremental import partial_events

    matched = Matched(docs, schema, by_page=True).settled(settle)
    events = partial_events(docs, engine.finalized_changes(matched, False))
    counts = {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert counts == {"result.partial": 4000, "block.extracted": 4000}
    assert time.perf_counter() - began < 30
