"""Archives: exact round trip, revisits, and edge cases."""

import io

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from docweft.llm import warc
from docweft.llm.common import fresh_dir

SCHEMA = "page_id long, url string, html string, payload string, revisit int, key string"


def rows(*given_rows):
    return [(i, u, h, "clash", 7, None) for i, u, h in given_rows]


def test_round_trip(spark):
    big = "<p>" + "x é " * 300_000 + "</p>"
    data = rows((1, "http://a/é b\r\nx", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", "WARC/1.1\r\n\r\n"), (None, "u", "<p>one</p>"), (7, "u", "<p>only</p>"), (7, "u", "<p>only</p>"), (None, None, "alone"))
    pages = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = warc.round_trip(pages).collect()
    want = []
    firsts = {}
    for i, _, h, *_ in data:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    for i, _, h, *_ in data:
        body = (h or "").encode()
        first = firsts.get(h or "")
        revisit = first is not None and i != first
        want.append((i, len(body), warc.digest(body), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_payloads_come_back(spark):
    data = rows(*((i, f"http://h/{i}", f"<html>page number {i} " + "same words " * 50 + "</html>") for i in range(300)))
    pages = spark.createDataFrame(data, SCHEMA).repartition(2)
    where = fresh_dir(spark, "warc-test")
    manifest = warc.write_archives(warc.plan_records(pages), where, archive_bytes=15_000)
    assert manifest.count() > 10
    assert warc.read_archives(manifest).rdd.getNumPartitions() == min(manifest.count(), 2 * spark.sparkContext.defaultParallelism)
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_archives(manifest, payloads=True).collect()}
    assert got == {i: (u, h) for i, u, h, *_ in data}


def test_dictionary_leads_the_file():
    records = [warc.record(i, "u", (f"<p>{i} " + "shared words in every record " * 20).encode(), None, False) for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and int.from_bytes(data[4:8], "little") > 0
    assert list(warc.read_archive(io.BytesIO(data))) == records
    assert len(data) < sum(map(len, records)) / 3


def test_cut_off_archives_are_refused():
    data = warc.archive([warc.record(1, "u", b"x" * 5000, None, False)])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_archive(io.BytesIO(data[:-3])))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=20))
def test_any_bytes(payloads):
    records = [warc.record(i, None, p, None, False) for i, p in enumerate(payloads)]
    assert [warc.parse(r)["payload"] for r in warc.read_archive(io.BytesIO(warc.archive(records)))] == payloads


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
