"""Chat formatting: exact round trip of any text, the turn machine, and edge cases."""

import random

from pyspark.sql import functions as F

from docweft.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid int"


def formatted(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, "clash", 0) for c, t, r, x in rows], SCHEMA).repartition(3)
    return chat.format_chat(df)


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "\\", "[", "<", "/", "s>", " ", "\n", "é", "😀", "", "$1"]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "tool", "[/ROLE]\\x", None, "User"])
            rows.append((c, t, role, rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])))
    rows.append((None, 0, "user", "no id"))
    rows.append((500, 0, "user", "long " * 200_000))
    out = formatted(spark, rows).select("conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out} == {c: [x[1:] for x in sorted(v)] for c, v in want.items()}
    for r in out:
        assert "".join(s.text for s in r.segments) == r.formatted
        said = "".join(x for _, role, x in sorted(want[r.conv_id]) if role == "assistant")
        unescaped = "".join(__import__("re").sub(r"(?s)\\(.)", r"\1", s.text) for s in r.segments if s.loss)
        assert unescaped == said


def test_turn_machine(spark):
    orders = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user", "assistant"], 3: ["assistant"], 4: ["user", "user"], 5: ["user"], 6: ["user", "assistant", "system"], 7: ["user", "tool"]}
    rows = [(c, t, r, "x") for c, roles in orders.items() for t, r in enumerate(roles)]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in formatted(spark, rows).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 2), 7: (False, 1)}


def test_rows_without_id_are_apart(spark):
    rows = [(None, k, "user", f"text {k}") for k in range(50)] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    out = formatted(spark, rows).select("conv_id", F.size(chat.read_turns(F.col("formatted"))).alias("n")).collect()
    assert sorted((str(r.conv_id), r.n) for r in out) == [("1", 2)] + [("None", 1)] * 50


def test_ties_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "first"), (1, 0, "user", "a")]
    turns = formatted(spark, rows).select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [t.text for t in turns] == ["first", "a", "a", "b"]
    assert formatted(spark, []).count() == 0
