"""Decontamination against a brute-force version on templates, and its edge cases."""

import random

from docweft.llm import decontaminate as dec

DOCS = "doc_id long, text string, item_id long, key string"
ITEMS = "item_id long, text string, doc_id long"


def brute(docs, items, width=5, least=0.8):
    """All placements of all items, window by window."""
    def tokens(text):
        words, codes, plain, slots = dec.canonical(text)
        return [w.strip(dec._STRIP).lower() for w in words], codes.tolist(), plain.tolist(), slots.tolist()

    def windows(codes, plain, slots, size):
        """(place, what has to be equal) of each window."""
        for at in range(len(codes) - size + 1):
            bare = sum(not x for x in slots[at : at + size]) >= min(2, size)
            yield at, (bare, size, tuple((codes if bare else plain)[at : at + size]))

    out, held, places_of = {}, {}, {}
    for j, q in items:
        qw, qc, qp, qs = tokens(q)
        size = min(width, len(qc))
        if size:
            held[j] = (qw, qs, size, len(qc) - size + 1)
            for b, key in windows(qc, qp, qs, size):
                places_of.setdefault(key, []).append((j, b))
    for i, t in docs:
        dw, dc, dp, ds = tokens(t)
        shifts = {}
        for size in {h[2] for h in held.values()}:
            for a, key in windows(dc, dp, ds, size):
                for j, b in places_of.get(key, ()):
                    pairs, places = shifts.setdefault(j, {}).setdefault(a - b, (set(), set()))
                    places.add(b)
                    pairs.update((held[j][0][b + k], dw[a + k]) for k in range(size) if held[j][1][b + k])
        for j, of_item in shifts.items():
            own = held[j][3]
            good = [(p, s) for p, s in of_item.values() if len({x for x, _ in p}) == len(p)]
            matched = len(set().union(*(s for _, s in good))) if good else 0
            if matched and matched >= least * own:
                out[i, j] = (own, matched, all(x == y for p, _ in good for x, y in p))
    return out


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(j, q, 9) for j, q in items], ITEMS)
    rows = dec.contaminated(d, b).collect()
    got = {(r.doc_id, r.item_id): (r.windows, r.matched, r.kind == "verbatim") for r in rows}
    assert len(got) == len(rows)
    want = brute([(i, t) for i, t in docs if i is not None and t], [(j, q) for j, q in items if j is not None and q])
    assert got == want
    return got


def test_cases(spark):
    item = "A train leaves the station at 45 km per hour and Maria waits for 3 hours. How far does the train go before Maria waits again?"
    other = item.replace("45", "72").replace("Maria", "Peter").replace("3 hours", "6 days")
    mixed = item.replace("45", "72").replace("Maria waits again", "Peter waits again")
    docs = [(1, "Some words. " + item + " More words."), (2, "Start here.\n" + other + "\nthe end"), (3, "x " + mixed), (4, "Nothing to see here at all."), (5, None), (6, ""), (None, item), (7, " ".join(item.split()[:14])), (1, "Some words. " + item + " More words."), (8, "well two plus two")]
    got = check(spark, docs, [(10, item), (11, None), (12, ""), (13, "two plus two"), (None, item), (14, "1 2 3 4 5 6 7 8"), (10, item)])
    assert got[1, 10][2] and not got[2, 10][2] and (3, 10) not in got and (4, 10) not in got and (7, 10) not in got
    assert (8, 13) in got


def test_blanks_of_all_kinds_and_bare_windows(spark):
    docs = [(1, "words alpha\u00a0beta\u2003gamma words"), (2, "so 1 2 3 4 5 6 7 8 then"), (3, "so 1 2 3 4 5 6 7 9 then 10 11 12 13 14"), (4, "Here Anna Berta Clara Dora Emma Frida. End"), (5, "Here Anna Berta Clara Dora Emma Greta. End")]
    got = check(spark, docs, [(1, "alpha\u00a0beta gamma"), (2, "1 2 3 4 5 6 7 8"), (3, "x Anna Berta Clara Dora Emma Frida")])
    assert (1, 1) in got and (2, 2) in got and (3, 2) not in got


def test_many_items_share_a_window(spark):
    """A window that 1,000 items share makes no product: pairs are sought by the items' own windows."""
    common = "which of the following is the"
    items = [(j, f"{common} colour q{j}a q{j}b q{j}c q{j}d q{j}e q{j}f".replace("q", "word")) for j in range(1000)]
    docs = [(i, f"start of text {i} {common} " + " ".join(f"filler{i}x{k}" for k in range(20))) for i in range(300)] + [(1000, "Some words " + items[7][1])]
    d = spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], DOCS)
    b = spark.createDataFrame([(j, q, 9) for j, q in items], ITEMS)
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(d, b).collect()] == [(1000, 7)]
    found = dec.settle(dec._windows_of(dec._rows(b, "item_id"), [5]).distinct()).withColumnRenamed("id", "item_id").withColumnRenamed("at", "item_at")
    hits = dec._windows_of(dec._rows(d, "doc_id"), [5], dec.build_filter(found)).withColumnRenamed("id", "doc_id")
    totals = found.groupBy("item_id").agg(dec.F.count_distinct("item_at").alias("windows"))
    assert dec._probed(dec.settle(hits), found, totals, 0.8).count() < 20


def test_random(spark):
    rng = random.Random(1)
    vocabulary = "alpha beta gamma delta Tom Ann 1 22 km m the of".split()
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))) for j in range(12)]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if i % 2:
            text[3:3] = rng.choice(items)[1].split()
        docs.append((i, " ".join(text)))
    assert check(spark, docs, items)


def test_empty_and_long(spark):
    none_d, none_b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    item = "one question that is long enough to be found in a text"
    d = spark.createDataFrame([(1, "word " * 400_000 + item, 1, "")], DOCS)
    b = spark.createDataFrame([(1, item, 1)], ITEMS)
    assert dec.contaminated(none_d, b).count() == 0 and dec.contaminated(d, none_b).count() == 0
    assert dec.contaminated(d, b).count() == 1
    assert dec.clean(d, b).count() == 0 and dec.clean(d, none_b).columns == d.columns
