"""Model outputs of every shape, decoded beside a plain version."""

import math
import random

from docweft.operators import aggregates, tensors

OUT = "doc_id string, start_values array<float>, start_shape array<int>, end_values array<float>, end_shape array<int>"
PLAN = "doc_id string, plan_no int, path string, offsets array<struct<start_char:int,end_char:int>>"


def test_batches_and_spans(spark):
    rng = random.Random(4)
    outputs, plans, want = [], [], set()
    for d in range(12):
        batch, length = rng.randint(1, 3), rng.randint(1, 80)
        shape = rng.choice([[batch, length], [batch, length, 1], [batch, 1, length]] + ([[length]] if batch == 1 else []) + ([[]] if batch == length == 1 else []))
        start, end = ([rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]) for _ in range(batch * length)] for _ in range(2))
        outputs.append((str(d), start, shape, end, [batch, length]))
        for b in range(batch):
            offsets = [None if rng.random() < 0.2 else (3 * i, 3 * i + rng.choice([0, 2])) for i in range(length)]
            plans.append((str(d), b, f"p{b % 2}", offsets))
            s, e = start[b * length : (b + 1) * length], end[b * length : (b + 1) * length]
            pairs = [
                (-math.sqrt(s[i] * e[j]), i, j) for i in range(length) for j in range(i, min(length, i + 33))
                if s[i] >= 0.5 and e[j] >= 0.5 and offsets[i] and offsets[j] and offsets[j][1] > offsets[i][0]
            ]
            want |= {(str(d), f"p{b % 2}", offsets[i][0], offsets[j][1], round(-c, 5)) for c, i, j in sorted(pairs)[:8]}
    good, bad = tensors.join_plans(spark.createDataFrame(outputs, OUT), spark.createDataFrame(plans, PLAN))
    assert bad.count() == 0 and good.count() == len(plans)
    assert {(r.doc_id, r.path, r.start_char, r.end_char, round(r.confidence, 5)) for r in tensors.decode_spans(good).collect()} == want


def test_errors(spark):
    outputs = [("a", [0.5] * 4, [2, 2], [0.5] * 2, [1, 2]), ("b", [0.5] * 3, [2, 2], [0.5] * 4, [2, 2]), ("c", [0.5], [1, 1, 1, 1], [0.5], []), ("d", None, None, [0.5], [1]), ("f", [0.5], [1], [0.5], [1])]
    plans = [(d, k, "p", []) for d in "abcde" for k in range(2)]
    good, bad = tensors.join_plans(spark.createDataFrame(outputs, OUT), spark.createDataFrame(plans, PLAN))
    assert good.count() == 0
    assert {r.doc_id: r.error for r in bad.collect()} == {
        "a": "UIE output batch size mismatch: start=2, end=1, plans=2", "b": "UIE output tensor shape [2, 2] expects 4 values, got 3", "c": "unsupported UIE output tensor rank `4` with shape [1, 1, 1, 1]",
        "d": "output was not returned", "e": "output was not returned", "f": "UIE output batch size mismatch: start=1, end=1, plans=0",
    }


def test_largest_output_and_rotation(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0], [2]), (1, 1, [3.0, 4.0], [1, 2]), (1, 2, [9.0], [1]), (2, 0, [], [0])], "id int, n int, values array<double>, shape array<int>")
    assert {r.id: (r.values, r.shape) for r in tensors.largest_output(rows, "id", "n").collect()} == {1: ([3.0, 4.0], [1, 2]), 2: ([], [0])}
    votes = spark.createDataFrame([(1, 89.6, 0.5), (1, -270.4, 0.4), (1, 180.0, 0.8), (2, 359.7, 0.5), (2, 0.2, 0.1), (2, 270.0, 0.6), (3, 10.0, -1.0)], "id int, r double, w double")
    assert {r.id: r.r for r in aggregates.rotation_vote(votes, "id", "r", "w").collect()} == {1: 90, 2: 270}
