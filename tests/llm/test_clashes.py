"""Columns of clashing names through the stages, ids with different texts, and attempts that are made twice."""

import pytest
from pyspark.sql import functions as F

from docweft.llm import neardup, packing, pii, quality, repeats, warc
from docweft.llm.queries import tokenizer_path

NAMES = ["__id", "__ID2", "__row", "__spans", "__base_spans", "__host", "__path", "__e", "__n_path", "__own0", "__OWN1", "__own2", "kept", "component_id", "spans"]
PASSAGE = " ".join(f"Passage sentence number {k} has quite a few words of its own." for k in range(6))


@pytest.fixture
def docs(spark):
    rows = [(1, PASSAGE, "en", "a"), (2, PASSAGE + " mail me at x@example.org", "en", "a"), (3, "Quite another text that stands alone.", "de", None), (None, PASSAGE, None, "b"), (4, None, "en", "b"), (4, None, "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})


def untouched(before, after):
    assert after.columns == before.columns
    for r in after.collect():
        assert all(r[n] == n + ("-" if r.doc_id is None else str(r.doc_id)) for n in NAMES)


def test_stages_keep_columns(spark, docs):
    untouched(docs, repeats.remove_repeats(docs))
    once = neardup.keep_one(docs)
    untouched(docs, once)
    assert sorted(r.doc_id or 0 for r in once.collect()) == [0, 1, 3, 4]
    red = pii.redact(docs)
    untouched(docs, red)
    assert [r.text[-7:] for r in red.where("doc_id = 2").collect()] == ["[EMAIL]"]
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    untouched(docs, quality.keep_good(docs, labels, F.col("source"), F.col("lang")))


def test_one_id_with_different_texts(spark):
    """What repeats in one text of an id is not cut out of its other text."""
    other = " ".join(f"Something else entirely, sentence {k}, with more than enough words in it." for k in range(6))
    rows = [(1, PASSAGE), (5, PASSAGE), (5, other), (6, other), (6, "Short.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in repeats.remove_repeats(df).collect()) == sorted([(1, PASSAGE), (5, ""), (5, other), (6, ""), (6, "Short.")])


def test_copies_of_a_row_are_dealt_out(spark):
    """A third of all rows alike: bins stay gapless, and as few as one leaf makes."""
    df = spark.createDataFrame([(None, "same words again")] * 400 + [(k, f"own words {k} " * (k % 50)) for k in range(800)], "doc_id long, text string")
    few = {}
    for leaf in (100_000, 60):
        rows = packing.pack_documents(df, tokenizer_path(), capacity=64, leaf_pieces=leaf).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 64
        few[leaf] = (len(rows), len(bins))
    assert few[60][0] == few[100_000][0] and few[60][1] <= few[100_000][1] * 1.02 + 1


def test_bin_of_very_many_empty_texts(spark):
    rows = packing.pack_documents(spark.range(2048).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), tokenizer_path()).collect()
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == list(range(2048))


def test_an_attempt_that_was_stopped_changes_nothing(spark, tmp_path):
    """Archives of another attempt of the same task lie beside those that the manifest names."""
    where = f"file://{tmp_path}/warc"
    rows = warc.plan_records(spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k % 3}</p>") for k in range(20)], "page_id long, url string, html string"))
    first = warc.write_archives(rows.where("page_id < 7"), where)
    second = warc.write_archives(rows, where)
    got = warc.read_archives(second).collect()
    assert sorted(r.page_id for r in got) == list(range(20))
    assert not {r.path for r in first.collect()} & {r.path for r in second.collect()}
    assert sorted(r.page_id for r in warc.read_archives(first).collect()) == list(range(7))
