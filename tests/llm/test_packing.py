"""Packing against a plain encoding of every document, and its edge cases."""

import zlib

import numpy as np
import pytest

from docweft.llm import packing
from docweft.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, sequence_id string"
TEXTS = [
    "Plain words, and plain words again. It's we'll 'tis x_y __",
    None,
    "",
    "\xa0 \x85 　",
    "Élan école ½ x² 日本語 don’t — “q” 123,4.5",
    "<|endoftext|> inside",
    "a\x1cb",
    "long " * 5000,
    "word " * 2047,
    "word " * 2046,
]


def expected(tokenizer, text, capacity):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(k, at, len(p := ids[at : at + capacity]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]


@pytest.mark.parametrize("leaf_pieces", [100_000, 3])
def test_pieces_and_layout(spark, leaf_pieces):
    from tokenizers import Tokenizer

    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "clash"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(docs, tokenizer_path(), 2048, leaf_pieces=leaf_pieces).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((str(i), *p) for i, t, _ in rows for p in expected(tokenizer, t, 2048))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + 1


def test_sequences_of_a_real_table(spark):
    """As few sequences as the tokens allow."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, tokenizer_path(), 2048).collect()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) == -(-total // 2048)


def test_another_tokenizer_is_encoded_whole(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as f:
        data = json.load(f)
    data["normalizer"]["normalizers"] = [n for n in data["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    assert packing.splits_as_parts(tokenizer_path()) and not packing.splits_as_parts(str(path))
    texts = ["Some WORDS in Case.", "x"]
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs, str(path), 2048).collect())
    tokenizer = Tokenizer.from_file(str(path))
    assert got == [(i, *p) for i, t in enumerate(texts) for p in expected(tokenizer, t, 2048)]


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_best_fit_is_tight():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2049, 5000)
    bins = packing.best_fit(lengths, 2048)
    filled = np.bincount(bins, weights=lengths)
    assert filled.max() <= 2048
    light = np.sort(filled)
    assert light[0] + light[1] > 2048  # no two bins could be one
