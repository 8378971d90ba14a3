"""Work that must not be done twice or by few tasks: what the plans of queries over large tables hold."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.functions.shared import dealt, each, fixed
from docweft.operators import incremental, requests
from docweft.operators.extract import EVIDENCE, extract
from docweft.plans.queries import QUERIES
from docweft.schema import FieldSpec, SchemaSpec
from docweft.sources import images, ingest

SF = "/root/testdata/sf0.001"


def bmp(width, height):
    step = (width * 3 + 3) // 4 * 4
    return b"BM" + bytes(8) + struct.pack("<IIiiHHI20x", 54, 40, width, height, 1, 24, 0) + bytes(k % 251 for k in range(step * height))


def plan(df):
    """The whole text of the optimized plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize("name", ["page_metadata", "ocr_document", "ocr_flatten"])
def test_answers_are_parsed_once(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("from_json(") == 1


def test_elements_of_lists(spark):
    rows = spark.createDataFrame([(1, [2, 3]), (4, []), (5, None)], "a int, b array<int>")
    assert sorted(map(tuple, rows.select("a", each("b").alias("x")).collect()), key=str) == [(1, 2), (1, 3), (4, None), (5, None)]


def test_dealt_rows_stay_dealt(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(spark.range(1000).coalesce(1), "id")
    assert rows.rdd.getNumPartitions() == parts
    assert rows.count() == 1000


def test_pictures_are_decoded_by_all_tasks(spark):
    assert QUERIES["page_tensor"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_of_tensors():
    pixels = [np.full((2, 3), k, np.float32) for k in range(2)]
    rows = [("a", 3, 2, 3, 2, 1.0, 1.0, 0, 0, 2, None), ("b", *(None,) * 9, "bad"), ("c", 3, 2, 3, 2, 1.0, 1.0, 1, 0, 2, None)]
    got = images._rows(rows, [pixels[0], None, pixels[1]], images._FIELDS).to_pylist()
    assert [r["values"] for r in got] == [[0.0] * 6, None, [1.0] * 6] and [r["error"] for r in got] == [None, "bad", None] and [r["width"] for r in got] == [3, None, 3]


def test_tensors_leave_a_task_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(str(k), bytearray(bmp(9, 40))) for k in range(3)], "doc_id string, content binary").coalesce(1)
    whole = sorted(map(tuple, images.page_tensors(rows).collect()), key=lambda r: (r[0], r[7], r[8]))
    monkeypatch.setattr(images, "GATHERED", 300)
    assert sorted(map(tuple, images.page_tensors(rows).collect()), key=lambda r: (r[0], r[7], r[8])) == whole and len(whole) == 3 * 3 * 2


def test_blocks_of_texts_are_made_once(spark):
    assert plan(QUERIES["extract_boolean"](spark, SF)).count("sha2(") == 1


def test_values_without_evidences(spark):
    docs = spark.createDataFrame([("a", "text", "k: yes", None, None, None), ("b", "text", "k: yes\nk: no", None, None, None), ("c", "text", "", None, None, None)], "doc_id string, source_type string, text string, url string, file_name string, mime_type string")
    docs = ingest.read_inline(docs)
    schema = SchemaSpec("s", "1", (FieldSpec("k", "boolean", multiple=True), FieldSpec("o", "object", children=(FieldSpec("k"),))))
    told = [sorted(repr(tuple(f[:5] for f in r.fields)) for r in extract(docs, schema, evidence).collect()) for evidence in (True, False)]
    assert told[0] == told[1]
    assert [len(f.evidences) for r in extract(docs, schema, False).collect() for f in r.fields] == [0] * 6


def test_equal_documents_keep_their_own_evidences(spark):
    rows = [(str(k), "text", f"name: {k % 2}", None, None, None) for k in range(40)]
    docs = ingest.read_inline(spark.createDataFrame(rows, "doc_id string, source_type string, text string, url string, file_name string, mime_type string").coalesce(1))
    got = extract(docs, SchemaSpec("s", "1", (FieldSpec("name"),))).collect()
    assert all(r.fields[0].value_json == f'"{int(r.doc_id) % 2}"' and len(r.fields[0].evidences) == 1 for r in got) and len(got) == 40
    assert len({r.fields[0].evidences[0].source_block_ids[0] for r in got}) == 40


def test_answers_are_judged_once(spark):
    held = plan(QUERIES["schema_left_join"](spark, SF))
    assert re.search(r"Filter isnull\((_extract_)?error#\d+\)|Filter isnull\(__row#\d+\.error\)", held)


def test_fixed_rows_are_as_they_were(spark):
    rows = spark.createDataFrame([(1, None, [1]), (None, "b", None)], "a int, b string, c array<int>")
    assert sorted(map(tuple, fixed(rows).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and fixed(rows).columns == rows.columns
    assert fixed(rows.limit(0)).count() == 0


def test_hits_are_told_in_one_pass(spark):
    rows = [("a", "sync", "k", 1), ("b", "async", "k", 2)]
    fields = "array<struct<key:string,value_json:string,items:array<string>,meaningful:boolean,confidence:float,evidences:array<" + EVIDENCE + ">>>"
    hits = spark.createDataFrame(rows, "doc_id string, mode string, cache_key string, hit_count bigint").select(
        "*", F.from_json(F.lit('[{"key":"x","value_json":"1","confidence":0.5,"evidences":[]},{"key":"y","value_json":"null","confidence":0.1,"evidences":[]}]'), fields).alias("fields"), F.lit('say "hi"').alias("raw_text"),
        F.lit(7).cast("bigint").alias("created_at_ms"), F.lit(8).cast("bigint").alias("last_accessed_at_ms"),
    )
    mode = lambda m: hits.where(F.col("mode") == m).select(F.col("doc_id").alias("task_id"), F.explode(F.array(*incremental.opening(m, False))).alias("e")).select("task_id", "e.*")
    apart = mode("sync").unionByName(mode("async")).unionByName(incremental.cache_events(hits)).unionByName(incremental.result_events(hits, cached=True))
    at_once = incremental.hit_events(hits.withColumn("shown", incremental.shown(F.col("fields"), F.col("raw_text"))), False)
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, apart.collect()))
    assert at_once.count() == 6 + 7


def test_requests_are_read_once(spark, tmp_path):
    """Judged requests come from what was kept of them, not from another reading of their JSON."""
    rows = [("1", "a", None, None, "sync", '{"name":"s","version":"1","fields":[]}', None), ("2", "b", None, None, "later", None, None)]
    spark.createDataFrame(rows, requests.UPLOAD).write.json(f"{tmp_path}/asked")
    asked = spark.read.schema(requests.UPLOAD).json(f"{tmp_path}/asked")
    judged = requests.judged(asked)
    assert "] json" in plan(asked) and "] json" not in plan(judged)
    assert {r.task_id for r in judged.collect()} == {"1", "2"}
