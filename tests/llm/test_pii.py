"""Personal data: base spans against plain Python, the added spans' model, and edge cases."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docweft.llm import pii
from docweft.llm.queries import pii_digest

SCHEMA = "doc_id long, text string, spans string, base_spans int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


TEXTS = [
    None,
    "",
    "mail a.b+c@d-e.example.com, c@d.e_f@g.h and é x@y.z.w! @@ a@b a@b..c",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.02.3.255 0000000000000000001.2.3.4 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 12345",
    "call +1 (443) 555-5793 or +49-30-1234567 now + 12 +1 2 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7",
    "😀 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 😀 a@b.co",
    "x" * 200_000 + "@b.co",
    "1 " * 100_000,
    "+1" + " " * 50_000,
    "a." * 50_000 + "@x.y",
]


def test_base_spans(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("a1.@+- ()é_") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS + noise)] + [(None, "a@b.co", None, None), (2, TEXTS[2], "", 2)]
    got = pii_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        for r in by_id[i]:
            want = base(t)
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:80]
            counts = (r.n_email, r.n_ip, r.n_card, r.n_phone)
            assert counts == tuple(sum(w.startswith(k + ":") for w in want) for k in PATTERNS)
            assert set(want) <= set(filter(None, r.spans.split(",")))


def test_secrets_are_added_and_redacted(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'Some words. token = "{key}" and version 1234567890123 done.', "", 0))
    for i in range(60, 90):
        rows.append((i, f"see /path-to-page/item-{i}-of-the-list/index-2 here", "", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = pii.fit(docs)
    assert set(model.reliability) == set(pii.LABELERS)
    out = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert [out[i] for i in range(60) if "[SECRET]" not in out[i]] == []
    assert [out[i] for i in range(60, 90) if out[i] != rows[i][1]] == []
    assert pii.redact(docs, model).columns == docs.columns


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = random.Random(7)
    counts = {}
    for _ in range(5000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth == (rng.random() < r) else -1) if rng.random() < 0.8 else 0 for r in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    share, right, _ = pii.expectation_maximisation([(0, v, n) for v, n in sorted(counts.items())])
    assert right == pytest.approx([0.95, 0.9, 0.6], abs=0.05) and share[0] == pytest.approx(0.4, abs=0.05)


def test_expectation_maximisation_finds_one_worse_than_chance():
    rng = random.Random(8)
    counts = {}
    for _ in range(5000):
        truth = rng.random() < 0.7
        votes = tuple((1 if truth == (rng.random() < r) else -1) for r in (0.95, 0.9, 0.85, 0.2))
        counts[votes] = counts.get(votes, 0) + 1
    share, right, _ = pii.expectation_maximisation([(0, v, n) for v, n in sorted(counts.items())])
    assert right == pytest.approx([0.95, 0.9, 0.85, 0.2], abs=0.05) and share[0] == pytest.approx(0.7, abs=0.05)


def test_added_spans_on_planted_texts(spark):
    """Precision and recall of the added spans where keys, numbers and addresses stand among look-alikes."""
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    digits = lambda n: str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    rows, planted = [], set()
    for i in range(400):
        kind = i % 8
        name = rng.choice(["anna.lee", "tom", "j_smith"])
        before, span, behind, true = [
            ('the token = "', hexes(40), '" is used', True), ("set api_key: ", mixed(32), " here", True), ("password=", mixed(24) + "9", " was", True),
            ("mail me at ", f"{name} (at) example (dot) org", " soon", True), ("see /docs", "/path-to-page/item-" + digits(4) + "-of-list", "/index", False),
            ("version ", digits(10), " of it", False), ("isbn ", digits(13), ". Next", False), ("commit ", "release-notes-for-build-" + digits(3), " and", False),
        ][kind]
        text = f"Words come first {'é' * (i % 3)} {before}"
        rows.append((i, text + span + behind, "clash", 1))
        if true:
            planted.add((i, len(text), len(text) + len(span)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = pii.fit(docs)
    found = {(r.doc_id, s.start, s.stop) for r in pii.with_spans(docs, model, base_col="b", spans_col="all").collect() for s in r.all if s.rank >= len(pii.BASE)}
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)


def test_no_limits_of_length(spark):
    """Long tokens before the first digit of a key, and long local parts of spelled-out addresses, are candidates."""
    rows = [(1, "token = " + "k" * 100 + "9", "", 0), (2, "n" * 100 + " (at) example.org", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = docs.select(F.explode(pii.candidates(F.col("text"), pii.base_spans(F.col("text")))).alias("c")).select("c.start", "c.stop").collect()
    assert sorted(map(tuple, spans)) == [(0, 117), (8, 109)]


def test_many_matches_in_one_text(spark):
    """A megabyte of addresses, base spans and candidates side by side, in one text."""
    text = "1.2.3.4 " * 125_000
    both = "".join(f"a{k}@b.co token = {k:040d}x " for k in range(4_000))
    docs = spark.createDataFrame([(1, text, "", 0), (2, both, "", 0), (3, "short", "", 0)], SCHEMA)
    began = time.perf_counter()
    out = {r.doc_id: r for r in pii_digest(docs).collect()}
    assert out[1].n_ip == 125_000 and out[2].n_email == 4_000
    assert time.perf_counter() - began < 60
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in pii.redact(docs, pii.SpanModel()).collect()}
    assert got[1] == "[IP] " * 125_000 and got[2].count("[EMAIL]") == 4_000
    assert time.perf_counter() - began < 60


def test_overlapping_spans_are_put_together(spark):
    spans = [(0, 1, 3), (2, 0, 9), (5, 2, 6), (9, 3, 12), (20, 0, 21)]
    df = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz" * 100, spans), ("x", [])], "text string, spans array<struct<start:int,rank:int,stop:int>>")
    rows = df.select(pii.merged(F.col("spans")).alias("m"), pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [tuple(s) for s in rows[0].m] == [(0, 1, 9), (9, 3, 12), (20, 0, 21)]
    assert rows[0].t == "[IP][PHONE]" + "mnopqrst[EMAIL]vwxyz" + "abcdefghijklmnopqrstuvwxyz" * 99 and rows[1].t == "x"


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pii_digest(docs).count() == 0 and pii.redact(docs).count() == 0
