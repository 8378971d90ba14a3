"""Repeated sentence spans against a brute-force version."""

import random

from docweft.llm import repeats

SCHEMA = "doc_id long, text string, spans string, first string"


def brute(rows, least_sentences, least_words):
    """Sentences removed of each text, by comparing all spans of that size or more."""
    occurrences = {}
    for i, t in rows:
        s = [tuple(t[a:b].lower().split()) for a, b in repeats.sentences(t)] if i is not None and t else []
        for a in range(len(s)):
            for b in range(a + least_sentences, len(s) + 1):
                if sum(map(len, s[a:b])) >= least_words:
                    occurrences.setdefault(tuple(s[a:b]), set()).add((i, a, b))
    gone = {}
    for places in occurrences.values():
        for i, a, b in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(a, b))
    return {i: len(g) for i, g in gone.items()}


def make(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(rng.randint(1, 12))).capitalize() + rng.choice(".!?") for _ in range(25)]
    passage = " ".join(f"Passage sentence number {k} has quite a few words of its own." for k in range(6))
    rows = []
    for i in range(40):
        text = rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        if i % 5 == 0:
            text += "\n" + passage + " " + rng.choice(pool)
        rows.append((i, text))
    return rows + [(None, passage), (100, None), (101, ""), (102, "one"), (103, passage + " " + passage)]


def test_against_brute_force(spark):
    for seed in range(3):
        rows = make(seed)
        docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA).repartition(3)
        got = {r.doc_id: r.n_removed for r in repeats.affected(docs, 2, 20).collect()}
        assert got == brute(rows, 2, 20)


def test_text_left(spark):
    passage = " ".join(f"Passage sentence number {k} has quite a few words of its own." for k in range(6))
    rows = [(1, "Own start. " + passage), (2, "Before it.\n" + passage + "\nAfter it. The end."), (3, "Alone here."), (None, passage), (2, "Before it.\n" + passage + "\nAfter it. The end.")]
    docs = spark.createDataFrame([(i, t, "s", "f") for i, t in rows], SCHEMA)
    out = repeats.remove_repeats(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert got == [(0, passage), (1, rows[0][1]), (2, "Before it.\nAfter it. The end."), (2, "Before it.\nAfter it. The end."), (3, "Alone here.")]
    assert [r.first_doc_ids for r in repeats.affected(docs).select("first_doc_ids").distinct().collect()] == [[1]]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert repeats.affected(docs).count() == 0 and repeats.remove_repeats(docs).count() == 0


def test_very_long(spark):
    text = "word " * 300_000 + ". " + "Short one here. " * 2000
    docs = spark.createDataFrame([(1, text, "", ""), (2, text, "", "")], SCHEMA)
    got = {r.doc_id: (r.n_removed, r.n_sentences) for r in repeats.affected(docs).collect()}
    assert got[2] == (2001, 2001) and got[1][0] == 1999


def test_short_last_sentences_of_a_copy(spark):
    text = " ".join(" ".join(f"w{k}x{j}" for j in range(n)) + "." for k, n in enumerate((30, 30, 3, 3)))
    rows = [(1, text), (2, text), (3, "Own start here. " + text + " Own end here.")]
    docs = spark.createDataFrame([(i, t, "s", "f") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_removed, r.n_sentences) for r in repeats.affected(docs).collect()}
    assert got == {2: (4, 4), 3: (4, 6)}


def test_tail_of_a_passage(spark):
    """Sentences of 15, 15 and 3 words: no run of 20 words begins at the second inside the passage."""
    passage = " ".join(" ".join(f"p{k}x{j}" for j in range(n)) + "." for k, n in enumerate((15, 15, 3)))
    rows = [(1, passage), (2, "Something else stands before it. " + passage + " And something else behind.")]
    docs = spark.createDataFrame([(i, t, "s", "f") for i, t in rows], SCHEMA)
    assert {r.doc_id: r.n_removed for r in repeats.affected(docs).collect()} == {2: 3}


def test_hot_passage(spark, monkeypatch):
    """A passage that all documents share is spread over tasks, with the same result."""
    from docweft.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 20)
    passage = " ".join(f"Passage sentence number {k} has quite a few words of its own." for k in range(4))
    rows = [(i, f"Own start number {i} here. " + passage) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "s", "f") for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_removed, list(r.first_doc_ids)) for r in repeats.affected(docs).collect()}
    assert got == {i: (4, [0]) for i in range(1, 200)}


def test_texts_that_lose_nothing_are_not_shuffled(spark):
    """A bitmap keeps every id that it holds, negative ones too, and few others."""
    rows = spark.range(-50_000, 50_000).selectExpr("id AS doc_id", "repeat('x', 20) AS text")
    ids = rows.where("doc_id % 4 = 0").select("doc_id")
    kept = repeats.may_have(rows, ids)
    assert kept.columns == rows.columns
    assert ids.join(kept, "doc_id", "left_anti").isEmpty()
    assert 25_000 <= kept.count() < 26_000


def test_rows_of_an_id_once_and_again(spark):
    passage = " ".join(f"Passage sentence number {k} has quite a few words of its own." for k in range(4))
    rows = [(1, passage), (2, "Own start here. " + passage), (3, passage + " Own end here.")]
    once = spark.createDataFrame([(i, t, "s", "f") for i, t in rows], SCHEMA)
    again = once.union(once)
    assert repeats.repeated_ids(once) == (False, False) and repeats.repeated_ids(again) == (False, True)
    want = [(2, 4, [1]), (3, 4, [1])]
    for docs in (once, again):
        got = repeats.affected(docs).select("doc_id", "n_removed", "first_doc_ids").distinct().collect()
        assert sorted((r.doc_id, r.n_removed, list(r.first_doc_ids)) for r in got) == want
    apart = once.union(spark.createDataFrame([(2, "Something else.", "s", "f")], SCHEMA))
    assert repeats.repeated_ids(apart) == (True, True)
