"""Vector codes against plain whole-number arithmetic."""

import random

import numpy as np
import pytest

from docweft.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, __own0 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", "e", "o") for i, v, x in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale):
    """(codes, errors, codebooks) in Python's whole numbers."""
    good = [(i, v, x) for i, v, x in rows if v and all(y is not None and np.isfinite(y) for y in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1])
    good = [(i, [max(-(2**26), min(2**26, int(np.floor(scale * float(np.float32(y)))))) for y in v], x) for i, v, x in good if len(v) == width]
    w = width // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in good]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(assign(p, c[p])[1], []).append(c[p])
            for k, own in held.items():
                books[p][k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    out = []
    for (i, _, x), c in zip(good, cut, strict=True):
        found = [assign(p, c[p]) for p in range(parts)]
        out.append((i, x, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    totals = {}
    for _, x, _, e in out:
        totals[x] = totals.get(x, 0) + e
    return sorted(((*r, totals[r[1]]) for r in out), key=repr), books


def make(seed, n=90, width=8):
    rng = random.Random(seed)
    value = lambda: rng.choice([0.0, 0.25, -0.25, 0.5, rng.uniform(-1, 1), rng.uniform(-1, 1)])
    rows = [(rng.randint(0, 60), [value() for _ in range(width)], rng.choice([None, 0, 1, 2])) for _ in range(n)]
    rows += rows[:5] + [(None, [value() for _ in range(width)], 1), (70, None, 1), (71, [0.5] * (width - 1) + [None], 1), (72, [float("nan")] * width, 2), (73, [float("inf")] + [0.0] * (width - 1), 2), (74, [1.0], None), (75, [], 0), (76, [3e38, -3e38] + [0.0] * (width - 2), 3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_whole_numbers(spark, seed):
    rows = make(seed)
    coded, books = codes.compress(frame(spark, rows).repartition(3), parts=4, entries=16, rounds=3)
    want, want_books = brute(rows, 4, 16, 3, 1024)
    assert books.entries.tolist() == want_books
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in coded.collect()), key=repr) == want


def test_screening_never_loses_the_nearest():
    """Entries so close together, and so large, that single precision can't tell them apart."""
    rng = np.random.default_rng(9)
    for size in (3, 1000, 2**20, 2**26):
        entries = rng.integers(-3, 4, (256, 16)) + rng.integers(-size, size + 1, 16)
        entries = np.clip(entries, -(2**26), 2**26)
        entries[100] = entries[7]
        x = np.clip(np.r_[entries[rng.integers(0, 256, 3000)] + rng.integers(-3, 4, (3000, 16)), rng.integers(-size, size + 1, (500, 16))], -(2**26), 2**26)
        index, distance = codes.nearest(x, entries)
        exact = np.stack([((x - e) ** 2).sum(1) for e in entries], 1)
        assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_few_and_no_rows(spark):
    rows = make(3, n=4)[:4]
    coded, books = codes.compress(frame(spark, rows), entries=256)
    want, want_books = brute(rows, 4, 256, 4, 1024)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in coded.collect()), key=repr) == want and books.entries.tolist() == want_books
    for none in ([], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        coded, books = codes.compress(frame(spark, none))
        assert coded.count() == 0 and books is None


def test_encode_and_decode_keep_columns(spark):
    df = frame(spark, make(4))
    books = codes.train(df, parts=2, entries=32, rounds=2)
    out = codes.decode(codes.encode(df, books), books)
    assert out.columns == ["vec_id", "embedding", "label", "__own0", "code", "error", "approximation"]
    for r in out.collect():
        whole = codes.scaled(np.array(r.embedding), 1024)
        assert r.error == int(((whole - np.array(r.approximation)) ** 2).sum()) and r["__own0"] == "o"


def test_hot_labels_are_spread(spark, monkeypatch):
    monkeypatch.setattr("docweft.llm.common.HOT_LEAST", 10)
    rows = [(i, [float(i % 7), 1.0, 0.5, float(i % 3)], 1 if i % 4 else None) for i in range(200)]
    coded, _ = codes.compress(frame(spark, rows), entries=3)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in coded.collect()), key=repr) == brute(rows, 4, 3, 4, 1024)[0]
