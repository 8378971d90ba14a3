"""Uploads with schemas of their own, beside the compiled schemas, and what happens to those that fail."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docweft.operators import requests
from docweft.operators.extract import extract
from docweft.plans import engine
from docweft.schema import FieldSpec, SchemaSpec
from docweft.sources import ingest
from tests.test_engine import make_docx, make_pdf
from tests.test_labels import documents, make


def some_field(rng, depth):
    key = rng.choice(["a", "b", "aa", "x1"])
    if depth and rng.random() < 0.5:
        kids = {f.key: f for f in (some_field(rng, depth - 1) for _ in range(rng.randint(1, 3)))}
        return FieldSpec(key, rng.choice(["object", "array"]), rng.random() < 0.5, False, tuple(kids.values()))
    return FieldSpec(key, rng.choice(["string", "number", "boolean", "object", "array"]), rng.random() < 0.5, rng.random() < 0.5, (), tuple(rng.sample(["a", "b", "aa"], rng.randint(0, 2))))


def test_schemas_as_rows_give_what_compiled_schemas_give(spark):
    rng = random.Random(11)
    pages = [(str(i), make(rng)) for i in range(6)]
    docs = documents(spark, pages)
    schemas = []
    for _ in range(8):
        fields = {f.key: f for f in (some_field(rng, 3) for _ in range(rng.randint(1, 3)))}
        schemas.append(SchemaSpec("s", "1", tuple(fields.values())))
    uploads = spark.createDataFrame([(f"{d}/{k}", d, "f", None, None, s.to_json(), '{"return_evidence": true, "return_raw_text": true}') for d, _ in pages for k, s in enumerate(schemas)], requests.UPLOAD)
    asked = requests.judged(uploads)
    assert asked.where("error is not null").count() == 0
    got = {r.task_id: r for r in requests.extract_requests(asked.withColumnRenamed("path", "doc_id"), docs).collect()}
    assert len(got) == len(pages) * len(schemas)
    for k, s in enumerate(schemas):
        for r in engine.finalized(extract(docs, s), s).collect():
            assert got[f"{r.doc_id}/{k}"].fields == r.fields and got[f"{r.doc_id}/{k}"].raw_text == r.raw_text


def test_refusals(spark):
    good = SchemaSpec("s", "1", (FieldSpec("a"),)).to_json()
    rows = [
        ("1", "p", None, None, None, None, None), ("2", None, None, None, None, good, None), ("3", "p", None, None, "x", good, None), ("4", "p", None, None, None, "{", None),
        ("5", "p", None, None, None, '{"name":"s","version":"1","fields":[]}', None), ("6", "p", None, None, None, good, "[1"), ("7", "p", None, None, None, good, "[]"),
        ("8", "p", None, None, " async ", good, '{"return_evidence":true}'), ("9", "p", None, None, None, '{"name":"s"}', None), ("10", "p", None, None, None, '{"name":"s","version":"1","fields":[{"key":"a"},{"key":"a "}]}', None),
    ]
    out = {r.task_id: r for r in requests.judged(spark.createDataFrame(rows, requests.UPLOAD)).collect()}
    assert [out[str(k)].error for k in range(1, 11)] == [
        "multipart field `schema` is required", "multipart field `file` is required", "mode must be sync or async", "malformed schema", "schema has no fields", "malformed options", "malformed options",
        None, "malformed schema", "fields: duplicate key a",
    ]
    assert (out["8"].mode, out["8"].return_evidence, out["8"].return_raw_text) == ("async", True, False)


def test_files_through_tasks(spark, tmp_path):
    """Files of all kinds, asked for twice, with readers that fail while someone waits and later; the cache keeps what succeeds."""
    files = {"a.txt": "岗位类型：甲".encode(), "b.docx": make_docx(["岗位类型：乙"]), "c.pdf": make_pdf(["k: v"]), "broken.png": b"\x89PNG", "scan.pdf": make_pdf([" "]), "bad.docx": b"zip?"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)

    def provider(request):
        raise RuntimeError("simulated OCR worker failure")

    def rasterizer(content):
        raise RuntimeError("failed to execute the rasterizer")

    schema = SchemaSpec("demo", "1", (FieldSpec("岗位类型"), FieldSpec("k"))).to_json()
    asked = [(f"{n}-{name}", name, None, None, "async" if name == "scan.pdf" else None, schema, None) for n in (1, 2) for name in files] + [("3-lost", "lost.txt", None, None, None, schema, None)]
    config = engine.EngineConfig(ocr_provider=provider, rasterizer=rasterizer)
    where = f"file://{tmp_path}"
    done = engine.run_uploads(ingest.list_files(spark, where), spark.createDataFrame(asked, requests.UPLOAD), config, now_ms=4)
    state = {r.task_id: r for r in done.tasks.collect()}
    assert len(state) == 13
    assert [json.loads(state[f"1-{n}"].fields[k].value_json) for n, k in (("a.txt", 0), ("b.docx", 0), ("c.pdf", 1))] == ["甲", "乙", "v"]
    assert all(state[f"2-{n}"].cached and state[f"2-{n}"].status == "succeeded" for n in ("a.txt", "b.docx", "c.pdf"))
    log = {}
    for r in done.events.orderBy("task_id", "sequence").collect():
        log.setdefault(r.task_id, []).append((r.event_type, json.loads(r.payload)))
        assert r.created_at_ms == 4
    for n in (1, 2):
        image, scan = state[f"{n}-broken.png"], state[f"{n}-scan.pdf"]
        assert image.status == scan.status == "failed" and "simulated OCR worker failure" in image.message and "failed to execute" in scan.message
        told = log[f"{n}-broken.png"]
        assert [k for k, _ in told] == ["task.accepted", "stage.changed", "stage.changed", "failed"]
        assert told[2][1]["stage"] == "failed" and "simulated OCR worker failure" in told[2][1]["message"] and "simulated OCR worker failure" in told[3][1]["message"]
        later = log[f"{n}-scan.pdf"]
        assert [p.get("stage") for _, p in later] == [None, "queued", "parsing", None] and "failed to execute" in later[3][1]["message"]
        assert state[f"{n}-bad.docx"].message == "docx: BadZipFile"
    assert state["3-lost"].message == "file not found" and done.cache.count() == 3
    again = engine.run_uploads(ingest.list_files(spark, where), spark.createDataFrame(asked[:1], requests.UPLOAD), config, cache=done.cache, now_ms=5)
    assert [(r.cached, r.message) for r in again.tasks.collect()] == [(True, "cache hit (hit_count=2, created_at_ms=4)")]


def test_one_schema_for_files(spark):
    """Files as a batch with one schema; their events tell of partial results page by page."""
    rows = [("x", "x.pdf", None, "pdf", bytearray(make_pdf(["k: v", "k: w"])), 9), ("y", "y.pdf", None, "pdf", bytearray(b"none"), 4)]
    files = spark.createDataFrame(rows, "doc_id string, file_name string, mime_type string, source_type string, content binary, byte_size bigint")
    done = engine.run_batch(files, SchemaSpec("s", "1", (FieldSpec("k", multiple=True),)))
    state = {r.task_id: (r.status, r.fields and r.fields[0].value_json) for r in done.tasks.collect()}
    assert state["x"] == ("succeeded", '["v","w"]') and state["y"][0] == "failed"
    partial = done.events.where("event_type = 'result.partial'").orderBy("sequence").select(F.get_json_object("payload", "$.field.value").alias("v"), F.get_json_object("payload", "$.pages_processed").alias("p")).collect()
    assert [tuple(r) for r in partial] == [('["v"]', "1"), ('["v","w"]', "2")]


@pytest.mark.parametrize("uploads", [[], [("1", "p", None, None, None, SchemaSpec("s", "1", (FieldSpec("a"),)).to_json(), None)]])
def test_empty_tables(spark, uploads):
    files = spark.createDataFrame([], "path string, content binary, byte_size bigint")
    done = engine.run_uploads(files, spark.createDataFrame(uploads, requests.UPLOAD))
    assert [r.message for r in done.tasks.collect()] == ["file not found"] * len(uploads)


def test_requests_with_schemas_in_lines(spark, tmp_path):
    """JSON lines whose schema and options are objects; an input that two requests bring under different schemas; the cache over two calls."""
    schema = json.loads(SchemaSpec("s", "1", (FieldSpec("a"), FieldSpec("b", "number"))).to_json())
    other = json.loads(SchemaSpec("t", "1", (FieldSpec("b", "number"),)).to_json())
    line = {"kind": "text", "content": "a: x\nb: 4"}
    lines = [
        line | {"task_id": "1", "schema": schema, "options": {"return_raw_text": True, "return_evidence": True}}, line | {"task_id": "2", "schema": other, "mode": "async"}, line | {"task_id": "3", "schema": schema},
        line | {"task_id": "4"}, line | {"task_id": "5", "schema": {"name": "s"}}, line | {"task_id": "6", "schema": schema, "content": " "}, {"task_id": "7", "kind": "url", "url": "http://x", "schema": other},
        line | {"task_id": "8", "schema": other},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken")
    good, refused = ingest.read_requests(spark, f"file://{tmp_path}", ingest.FULL_REQUEST)
    assert [(r.task_id, r.error) for r in refused.orderBy("task_id").collect()] == [(None, "malformed request"), ("6", "content is required")]
    asked = good.unionByName(refused.where("task_id is not null").drop("error"))
    done = engine.run_requests(asked, now_ms=2)
    state = {r.task_id: r for r in done.tasks.collect()}
    values = {k: [json.loads(f.value_json) for f in state[k].fields] for k in "12378"}
    assert values == {"1": ["x", 4], "2": [4], "3": ["x", 4], "7": [None], "8": [4]} and state["1"].raw_text == "a: x\nb: 4" and state["3"].raw_text is None
    assert len(state["1"].fields[0].evidences) == 1 and len(state["3"].fields[0].evidences) == 0 and [k for k in sorted(state) if state[k].cached] == ["8"]
    assert [state[k].message for k in "456"] == ["multipart field `schema` is required", "malformed schema", "content is required"]
    again = engine.run_requests(asked.where("task_id = '3'"), cache=done.cache, now_ms=3)
    assert [(r.cached, r.message) for r in again.tasks.collect()] == [(True, "cache hit (hit_count=1, created_at_ms=2)")]
