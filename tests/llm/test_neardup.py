"""Near duplicates against a brute-force version, also in one large group, and edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweft.llm import neardup
from docweft.llm.common import marked

SCHEMA = "doc_id long, text string, n long, id long, component string"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(spark, rows, width=4, percent=80):
    docs = spark.createDataFrame([(i, t, 1, 2, "clash") for i, t in rows], SCHEMA).repartition(3)
    out = neardup.near_duplicates(docs, width, percent).collect()
    assert len(out) == len(rows)
    want = brute(rows, width, percent)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    return want


def family(rng, base, n, rate):
    return [" ".join(rng.choice("xyzuvw") * 3 if rng.random() < rate else w for w in base) for _ in range(n)]


def test_groups_and_chains(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(500)]
    rows = []
    for k in range(4):  # near copies around the threshold: many links do not touch the smallest id
        base = [rng.choice(words) for _ in range(150)]
        rows += [(100 * k + i, t) for i, t in enumerate(family(rng, base, 60, 0.005 + 0.01 * k))]
    base = [rng.choice(words) for _ in range(120)]
    rows += [(1000 + i, " ".join(base[i : i + 60])) for i in range(40)]  # a chain of overlaps
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(100)]
    rows += [(3000 + i, "The very same TEXT in every copy") for i in range(50)]
    want = check(spark, rows)
    assert len({c for _, c in want.values()}) < 250


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"), (None, "one"), (None, None), (8, "\xa0"), (9, "É é"), (10, "é é"), (4, "one"), (11, "w " * 100_000), (12, "w " * 90_000)]
    check(spark, rows)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None), (3, "a b c d e f"), (7, "of its own"), (7, "of its own")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "7", "9", "None"]


def test_one_id_with_different_texts(spark):
    """All texts of an id are one document, and the smallest text stays."""
    one, two, three = ("first text of this id here", "second text quite unlike the other", "third one for good measure")
    rows = [(7, two), (7, one), (3, two), (9, one), (4, three), (8, None), (8, "b c"), (8, "a c")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == {(7, 3, False), (3, 3, True), (9, 3, False), (4, 4, True), (8, 8, True)}
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(docs).collect()) == [(3, two), (4, three), (8, "a c")]


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(1)
    rows = []
    for true in (0.0, 0.5, 0.8, 1.0):
        n = 2000
        both = int(2 * n * true / (1 + true))
        pool = rng.integers(0, 2**63, 2 * n - both).astype("u8")
        a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
        lanes = [neardup.packed_low_bits(neardup.minima(x)).tolist() for x in (a, b)]
        rows.append((true, *lanes))
    kind = "struct<" + ",".join(f"{s}:long" for s in neardup.LANE) + ">"
    df = spark.createDataFrame([(t, tuple(a), tuple(b)) for t, a, b in rows], f"t double, a {kind}, b {kind}")
    for r in df.select("t", neardup.estimate("a", "b").alias("e")).collect():
        assert r.e == pytest.approx(r.t, abs=0.13)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_linked(a, b):
    x, y = (np.array(sorted(s), "u8") for s in (a, b))
    if a and b:
        assert neardup.linked(x, y, 80) == (100 * len(a & b) >= 80 * len(a | b))


def test_link_behind_unlike_pivots(spark):
    """Every common bucket of two linked texts has a smaller member that is unlike both."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words = [word() for _ in range(120)]
    a, b = " ".join(words), " ".join(words + [word() for _ in range(20)])
    keys = lambda t: neardup.band_keys(neardup.minima(neardup.shingle_set(t, 4)))
    windows = [" ".join(words[j : j + 4]) for j in range(len(words) - 3)]
    each = np.stack([neardup.minima(neardup.shingle_set(w, 4)) for w in windows])
    ka, kb = keys(a), keys(b)
    rows = []
    for band in np.flatnonzero(ka == kb):
        held = [windows[j] for j in sorted(set(each[:, neardup.ROWS * band : neardup.ROWS * (band + 1)].argmin(axis=0)))]
        quote = next(t for t in ((" " + word() + " ").join(held) for _ in range(5000)) if keys(t)[band] == ka[band])
        rows.append((len(rows) + 1, quote))
    want = check(spark, [*rows, (1000, a), (1001, b)])
    assert len(rows) > 3 and want[1001][1] == 1000


def test_texts_of_no_candidate_are_not_shuffled(spark):
    """Of texts that share no bucket, and of rows that stay, only the few that the bitmap can't tell apart are joined by shuffle."""
    docs = spark.range(-20_000, 20_000).selectExpr("id AS doc_id", "concat(id, ' of its own ', id * 7, ' and ', id * 31) AS text", "1L AS `__own0`", "id AS `a.b`")
    ids = docs.where("doc_id % 8 = 0").select("doc_id")
    told = marked(docs, F.col("doc_id"), ids, "mark")
    assert told.columns == [*docs.columns, "mark"] and told.count() == docs.count()
    assert ids.join(told.where("mark"), "doc_id", "left_anti").isEmpty()
    assert told.where("mark").count() < 5_200
    assert marked(docs.selectExpr("cast(null AS long) AS doc_id"), F.col("doc_id"), ids, "mark").where("mark").isEmpty()
    plan = neardup.keep_one(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in plan.collect()) == [1, 3]
    shape = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in shape and "bitmap_construct_agg" in shape
