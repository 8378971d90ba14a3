"""Collocations against a count of all phrases."""

import random
import re
from collections import Counter

import pytest

from docweft.llm import phrases

SCHEMA = "text string, lang string, phrase string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(t, x, "p", "r") for t, x in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, most, least, inside_percent, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[lang, w[i : i + m]] = max(around[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in found.items():
        if around[lang, w] and 100 * around[lang, w] >= inside_percent * a:
            continue
        score, k = min((1000000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, n, p.decode(), -a, left, right, totals[lang], -s) for lang, rows in out.items() for n, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def make(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "strasse", "𝔘", "\xa0x", "a", "b", "c", "d", "New", "york", "city"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 40)))
    rows = [(text() + rng.choice(["", "New York City", "new york city.", " of the "]), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return rows + rows[:7] + [(None, "en"), ("", None), (" \t\n.", "de"), ("x " * 3000, "en"), ("New York City" * 20, "fr")]


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("seed, most, least, top, limit", [(1, 3, 5, 2000, 2000), (2, 3, 3, 7, 1), (3, 4, 3, 2000, 20), (4, 2, 5, 3, 1)])
def test_against_a_count_of_all_phrases(spark, monkeypatch, seed, most, least, top, limit):
    """Also with limits so low that most prefixes are dealt by their extensions, and with small blocks and looks."""
    monkeypatch.setattr(phrases, "PREFIX_LEAST", limit)
    monkeypatch.setattr(phrases, "PREFIX_MOST", limit)
    rows = make(seed)
    got = rows_of(phrases.collocations(frame(spark, rows).repartition(3), most=most, least=least, top=top))
    assert got == brute(rows, most, least, 50, top)


def test_words_and_pieces():
    import pyarrow as pa

    for size in (1, 10, 10_000):
        phrases_block, phrases.BLOCK_BYTES = phrases.BLOCK_BYTES, size
        try:
            batch = pa.RecordBatch.from_arrays([pa.array(["x", "n", "y"]), pa.array(["Ab c.d", None, "é\tF  g"])], ["lang", "text"])
            got = []
            for langs, words, lang, word, piece in phrases._blocks(iter([batch])):
                got += [(langs[k], words[int(w)].as_py()) for k, w in zip(lang, word, strict=True)]
            assert got == [("x", "ab"), ("x", "c"), ("x", "d"), ("y", "é"), ("y", "f"), ("y", "g")]
        finally:
            phrases.BLOCK_BYTES = phrases_block


def test_equal_words_have_equal_numbers():
    import pyarrow as pa

    words = ["a", "", "ab", "ba", "é", "a" * 1000, "\x00", "\x00\x00"]
    one = phrases._hashed(pa.array(words))
    two = phrases._hashed(pa.array(["other", *words[::-1], "more"]))[1:-1][::-1]
    assert (one == two).all() and len(set(one.tolist())) == len(words)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("", "en")])).count() == 0
