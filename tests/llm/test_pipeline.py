"""The pipeline against a plain Python version of each stage on the same rows, and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweft.llm import decontaminate, neardup, packing, pii, quality
from tests.llm.test_decontaminate import brute as leaks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near(rows):
    """doc_ids that stay: the smallest of each component."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i for i in ids if top(i) == i}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("small")
    source = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"file://{where}/{name}.parquet")
    return f"file://{where}"


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    texts = [(r.doc_id, r.text) for r in docs.collect()]

    first = corpus_pipeline.good_documents(spark, docs, small)
    assert first.columns == docs.columns
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r.doc_id for r in quality.classify(docs, labels, F.col("source"), F.col("lang")).where("kept").collect()}
    assert {r.doc_id for r in first.collect()} == kept and 0 < len(kept) < len(texts)

    second = corpus_pipeline.distinct_documents(spark, docs, small)
    assert second.columns == docs.columns
    assert {r.doc_id for r in second.collect()} == near(texts)

    third = corpus_pipeline.uncontaminated_documents(spark, docs, small)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {i for i, _ in leaks(texts, items)}
    assert third.columns == docs.columns and held
    assert {r.doc_id for r in third.collect()} == {i for i, _ in texts} - held

    fourth = corpus_pipeline.redacted_documents(spark, docs, small)
    assert fourth.columns == docs.columns
    spans = {r.doc_id: r for r in pii.with_spans(docs, pii.fit(docs)).collect()}
    for r in fourth.collect():
        before, at, want = spans[r.doc_id].text, 0, []
        for s in spans[r.doc_id].spans:
            if s.start >= at:
                want += [before[at : s.start], f"[{pii.KINDS[s.rank].upper()}]"]
            at = max(at, s.stop)
        assert r.text == "".join(want) + before[at:] and r.n_chars == len(r.text)


def test_run(spark, small):
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), DOCS)
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, "word " * 50_000, "en", "s", 250_000)]
    where = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    got = corpus_pipeline.run(spark, where).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 4}
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{where}/documents.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0


def test_texts_go_in_small_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(keys[0], given)
            corpus_pipeline.lean(spark)
            assert [spark.conf.get(k) for k in keys] == [want, "1000"]
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_a_worker_remembers_the_words_of_one_stage(monkeypatch):
    monkeypatch.setattr(packing, "_LOADED", {})
    path = corpus_pipeline.tokenizer_path()
    filled = {
        "quality": lambda: (quality.features("some words here"), len(quality._SLOTS))[1],
        "near_dedup": lambda: (neardup.shingle_set("some words here", 2), len(neardup._HASHES))[1],
        "decontamination": lambda: (decontaminate.canonical("some words here"), len(decontaminate._TOKENS))[1],
        "packing": lambda: (list(packing.PartCache.of(path, 10).encode_all(["some words here"])), len(packing._LOADED))[1],
    }
    tables = lambda: {"quality": quality._SLOTS, "near_dedup": neardup._HASHES, "decontamination": decontaminate._TOKENS, "packing": packing._LOADED}
    for name in (*filled, *filled):
        assert filled[name]() and filled[name]()
        assert [k for k, v in tables().items() if v] == [name]


def test_bounded_tables_give_the_same_ids():
    texts = [f"Word{i} and part-{i * 7} of {i % 3}" for i in range(300)]
    path = corpus_pipeline.tokenizer_path()
    some = packing.PartCache.of(path)
    want = [b"".join(some.encode_all([t])) for t in texts]
    few = packing.PartCache.of(path, 20)
    assert [b"".join(few.encode_all([t])) for t in texts] == want
    assert len(few.new) <= 20 + len(texts[0].split()) * 3
    assert packing.PartCache.of(path).entries == packing.ENTRIES


def test_words_carry_no_values_to_the_fit():
    """Rows with the values behind the words alone give the weights that rows with all values give."""
    rows = [quality.features(f"good words {i} of a text, number {i % 5}" if i % 2 else f"BUY {i} now!!! {i}") for i in range(400)]
    good = np.arange(400) % 2.0
    short = [(s, v[np.count_nonzero(s < quality._SHAPE) :].astype("f4")) for s, v in rows]
    assert all(len(v) < len(s) for s, v in short)
    assert np.array_equal(quality.train(short, good), quality.train([(s, v.astype("f4")) for s, v in rows], good))


def test_packed_bitmap():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 256, decontaminate.FILTER_BITS // 8, dtype="u1")
    keys = rng.integers(0, 2**64, 5000, dtype="u8")
    plain = np.unpackbits(bits, bitorder="little")[(keys >> np.uint64(39)).astype("i8")]
    assert 0 < plain.sum() < len(plain)
    assert np.array_equal(decontaminate.maybe_known(keys, bits), np.flatnonzero(plain))
