"""Exact top-k against all inner products, and edge cases."""

import math
import random

from pyspark.sql import functions as F

from docweft.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label string, score long, rank int"


def brute(rows, k, chosen):
    """Sorted answers of every query row, from every row but itself."""
    good = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if chosen(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for m, j, c in good if m != n and len(c) == len(q))
            out += [(i, r + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA)
    got = topk.exact_topk(df, F.col("vec_id") % 10 == 0, k, **options).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k, lambda i: i % 10 == 0)


def test_repeated_rows(spark):
    """Rows of one id, equal or not, are rows of their own; each query row has its own answers."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (7, [0.5, 0.0]), (-4, [2.0, 2.0])]
    check(spark, rows)
    check(spark, rows * 20, k=3, tile_rows=30, query_rows=11)


def test_random_tiles_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 20) for i in range(60)]  # one vector many times: ties
    check(spark, rows)
    check(spark, rows, tile_rows=40, query_rows=7)
    check(spark, rows[:7])


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (10, [1e9, -3e9]), (20, [0.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 1.0]), (None, [5.0, 5.0]), (8, [-1e300, 1e300]), (30, [2.0])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, [1.0])])
