"""The engine on the fixed cases: extraction, readers, OCR answers, events and tasks."""

import io
import json
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import aggregates, assemble, incremental, postprocess, vision
from docweft.operators.extract import extract
from docweft.plans import engine
from docweft.schema import FieldSpec, SchemaSpec, prompt
from docweft.sources import docx, ingest, ocr, pdf
from docweft.streaming import tasks

INPUT = "doc_id string, source_type string, text string, url string, file_name string, mime_type string"


def one(spark, text, *fields, **options):
    inputs = spark.createDataFrame([("d", "text", text, None, None, None)], INPUT)
    config = engine.EngineConfig(return_raw_text=True, return_evidence=True, **options)
    results, _ = engine.extract(inputs, SchemaSpec("s", "1", fields), config)
    return results.first().fields


def value(f):
    return json.loads(f.value_json)


def test_hint_number_and_boolean(spark):
    f = one(spark, "Abteilung：Einkauf Süd\nPlätze：17 Stück\noffen：有", FieldSpec("department", hints=("Abteilung",)), FieldSpec("Plätze", "number"), FieldSpec("offen", "boolean"))
    assert [value(x) for x in f] == ["Einkauf Süd", 17, True]


def test_object_and_rows(spark):
    text = "树种：银杏\n特点：秋天变黄\n特点：寿命很长"
    spec = FieldSpec("tree", "object", children=(FieldSpec("树种"), FieldSpec("特点", multiple=True)))
    assert value(one(spark, text, spec)[0]) == {"树种": "银杏", "特点": ["秋天变黄", "寿命很长"]}
    rows = FieldSpec("rows", "array", children=(FieldSpec("a", multiple=True), FieldSpec("b", "number", multiple=True)))
    assert value(one(spark, "a: x\na: y\nb: 1", rows)[0]) == [{"a": "x", "b": 1}, {"a": "y", "b": None}]


def test_quirks(spark):
    key = FieldSpec("a")
    assert value(one(spark, "a:\nnext line", key)[0]) == "next line"
    assert value(one(spark, "- a : v \n", key)[0]) == "v"
    assert value(one(spark, "x a: v", key)[0]) is None
    assert value(one(spark, "A: v", key)[0]) is None
    assert value(one(spark, "a: v\r\nb: w", key)[0]) is None
    assert value(one(spark, "(a)+: v", FieldSpec("(a)+"))[0]) == "v"
    missing = one(spark, "nothing", FieldSpec("a", required=True), FieldSpec("b"), FieldSpec("c", multiple=True), FieldSpec("d", "object"))
    assert [round(x.confidence, 4) for x in missing] == [0.05, 0.1, 0.1, 0.1]
    assert [value(x) for x in missing] == [None, None, [], {}]


@pytest.mark.parametrize("raw, want", [("42 人", "42"), ("1,234.50", "1234.5"), ("-7", "-7"), ("４２", None), ("none", None), ("9" * 20, "1.0E20")])
def test_numbers(spark, raw, want):
    assert spark.range(1).select(T.number_json(F.lit(raw)).alias("n")).first().n == want


def test_schema_rules():
    good = SchemaSpec("s", "1", (FieldSpec("a", "object", children=(FieldSpec("x"), FieldSpec("y", hints=("z", " z ")))),))
    assert SchemaSpec.from_json(good.to_json()) == good and [p for p, _ in good.leaves()] == [("a", "x"), ("a", "y")]
    assert prompt(("a", "y"), good.fields[0].children[1]) == "a/y；别名：z，z"
    for bad in (SchemaSpec("", "1", (FieldSpec("a"),)), SchemaSpec("s", "1", ()), SchemaSpec("s", "1", (FieldSpec("a"), FieldSpec(" a "))), SchemaSpec("s", "1", (FieldSpec("a", children=(FieldSpec("b"),)),))):
        with pytest.raises(ValueError):
            bad.validate()


def test_postprocess_evidences(spark):
    e = "array<struct<page_no:int,text:string,bbox:struct<x1:float,y1:float,x2:float,y2:float>,source_block_ids:array<string>>>"
    rows = spark.createDataFrame([([(2, " b ", None, ["x"]), (1, "a", None, ["b2", "b1", "b2"]), (1, " a", None, ["b1", "b2"]), (None, "z", None, [])],)], f"e {e}")
    got = rows.select(postprocess.normalize_evidences(F.col("e")).alias("e")).first().e
    assert [(x.page_no, x.text, x.source_block_ids) for x in got] == [(None, "z", []), (1, "a", ["b1", "b2"]), (2, "b", ["x"])]


def make_docx(paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(docx.ENTRY, "<w:document>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:document>")
    return out.getvalue()


def make_pdf(pages, flate=False):
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"}
    streams = {}
    for i, text in enumerate(pages):
        objects[3 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>"
        body = ("BT /F1 12 Tf " + " T* ".join(f"({x}) Tj" for x in text.split("\n")) + " ET").encode("latin-1")
        streams[4 + 2 * i] = zlib.compress(body) if flate else body
    out = b"%PDF-1.4\n"
    for n in sorted([*objects, *streams]):
        if n in objects:
            out += f"{n} 0 obj\n{objects[n]}\nendobj\n".encode()
        else:
            head = f"<< /Length {len(streams[n])}{' /Filter /FlateDecode' if flate else ''} >>".encode()
            out += f"{n} 0 obj\n".encode() + head + b"\nstream\n" + streams[n] + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_texts():
    assert pdf.page_texts(make_pdf(["role_type: pdf text", "a \\(b\\)\nc"], flate=True)) == ["role_type: pdf text\n", "a (b)\nc\n"]
    with pytest.raises(ValueError):
        pdf.page_texts(b"no")


def test_files_of_all_kinds(spark, tmp_path):
    files = {
        "a.docx": make_docx(["role_type：docx &amp; text", "x"]), "b.pdf": make_pdf(["role_type: pdf text"]), "c.txt": "role_type: plain".encode(), "d.md": b"# t\nrole_type: mark",
        "e.png": b"\x89PNG", "f.bin": b"\0\1", "bad.docx": b"zip?", "bad.pdf": b"?", "bad.txt": b"\xff\xfe", "scan.pdf": make_pdf([" "]),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    results, errors = engine.extract_files(spark, f"file://{tmp_path}", SchemaSpec("s", "1", (FieldSpec("role_type"),)), engine.EngineConfig(return_raw_text=True))
    rows = results.collect()
    assert sorted(x for x in (value(r.fields[0]) for r in rows) if x) == ["docx & text", "mark", "pdf text", "plain"]
    assert errors.count() == 3 and len(rows) == 7
    assert sum("ocr placeholder" in r.raw_text for r in rows) == 2


def test_fallback_provider():
    def broken(_):
        raise OSError("down")

    assert "placeholder" in ocr.with_fallback(broken, ocr.placeholder_provider)({"file_name": "x"})
    with pytest.raises(RuntimeError):
        ocr.with_fallback(broken, broken)({})


def test_ocr_answers(spark):
    answer = {"request_id": " r ", "warnings": [" w", "w", ""], "pages": [{"page_no": 0, "blocks": [{"text": "", "lines": [{"text": " a "}, {"text": ""}, {"text": "b"}]}]}, {"page_no": 2, "width": 0, "height": 5.0, "blocks": []}]}
    row = ocr.parse_answers(spark.createDataFrame([(json.dumps(answer),)], "answer string")).first()
    assert [(b.block_id, b.page_no, b.text, b.line_count) for b in row.blocks] == [("ocr-p1-b1", 1, "a\nb", 3)]
    assert row.warnings == ["w"] and row.request_id == "r" and [(p.page_no, p.width, p.height) for p in row.pages] == [(1, None, None), (2, None, 5.0)]


def test_inner_blanks_are_linear(spark):
    """A text with a million inner blanks."""
    began = time.perf_counter()
    assert spark.range(1).select(F.length(T.utrim(F.concat(F.lit(" x"), F.repeat(F.lit(" "), 1_000_000), F.lit("y \u3000")))).alias("n")).first().n == 1_000_002
    assert time.perf_counter() - began < 20


def test_ocr_documents(spark, tmp_path):
    """Boxes, confidences, ids, sizes and metadata survive; every file is sent once; rasters are gathered page by page."""
    calls = tmp_path / "calls"
    calls.mkdir()
    box = {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}

    def provider(request):
        (calls / f"{request['file_name']}-{len(list(calls.iterdir()))}-{id(request)}").write_text(json.dumps(ocr.request_headers(request)))
        page = {"page_no": 1, "width": 20, "height": 10, "rotation_degrees": 90, "warnings": ["page warning"]}
        lines = [{"text": " role: seen ", "page_no": 1, "block_id": "b7", "bbox": box, "confidence": 0.5}]
        return json.dumps({"provider": "P", "model": "M", "request_id": "r1", "timing_ms": 7, "pages": [page], "lines": lines})

    src = tmp_path / "files"
    src.mkdir()
    (src / "e.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (20).to_bytes(4, "big") + (10).to_bytes(4, "big"))
    (src / "scan.pdf").write_bytes(make_pdf([" ", " "]))
    config = engine.EngineConfig(ocr_provider=provider, rasterizer=lambda data: [(1, "image/png", b"one"), (2, "image/png", b"two")], return_evidence=True)
    docs, errors = engine.read_documents(spark, f"file://{src}", config)
    rows = {r.source_type: r for r in docs.collect()}
    assert errors.count() == 0 and len(list(calls.iterdir())) == 3
    image, scan = rows["image"], rows["pdf"]
    block = image.pages[0].blocks[0]
    assert (block.block_id, block.text, block.bbox.x2, block.confidence, block.source_kind) == ("b7", "role: seen", 3.0, 0.5, "ocr")
    assert (image.pages[0].width, image.pages[0].height) == (20.0, 10.0)
    extra = image.metadata.extra
    assert extra["ocr_page_1_rotation_degrees"] == "90" and extra["ocr_page_1_request_id"] == "r1" and extra["ocr_page_1_timing_ms"] == "7"
    assert extra["ocr_page_1_warning_1"] == "page warning" and extra["ocr_page_1_line_count"] == extra["ocr_page_1_block_count"] == "1"
    assert (extra["ocr_provider"], extra["ocr_model"], extra["ocr_request_id"]) == ("P", "M", "r1")
    assert [p.page_no for p in scan.pages] == [1, 2] and scan.plain_text == "role: seen\nrole: seen"
    extra = scan.metadata.extra
    assert (extra["pdf_parse_mode"], extra["pdf_ocr_input"], extra["ocr_timing_ms"], extra["page_count"], extra["ocr_warning_count"]) == ("ocr_fallback", "page_rasters", "14", "2", "1")
    sent = [json.loads(f.read_text()) for f in calls.iterdir()]
    assert sorted(h.get("x-ocr-page-no-hint", "") for h in sent) == ["", "1", "2"]
    assert sum(h.get("x-ocr-meta-pdf-ocr-input") == "page_rasters" for h in sent) == 2 and {h["x-ocr-source-type"] for h in sent} == {"image", "pdf"}
    assert ocr.image_size(b"GIF89a" + b"\x05\0\x06\0") == (5, 6) and ocr.image_size(b"none") is None
    bad = spark.createDataFrame([([(0, b"x")],), ([(1, b"")],), ([(1, b"x"), (1, b"y")],), ([(1, b"x")],)], "p array<struct<page_no:int,content:binary>>")
    assert [r.e is None for r in bad.select(ocr.raster_error(F.col("p")).alias("e")).collect()] == [False, False, False, True]


def test_normalized_and_prefixes(spark):
    doc = {"source_type": "text", "protocol_version": "1", "plain_text": "ignored", "metadata": {"extra": {"ingest_mode": "mine"}}, "pages": [{"page_no": n, "blocks": [{"page_no": n, "text": f"k: v{n}"}]} for n in (1, 2)]}
    rows = spark.createDataFrame([("d", json.dumps(doc)), ("bad", json.dumps({"plain_text": "x"}))], "doc_id string, j string")
    fields = ocr._colons(assemble.NORMALIZED)
    docs = rows.withColumn("n", F.from_json("j", f"struct<{fields}>")).select("doc_id", "n.*")
    results, errors = engine.extract_normalized(docs, SchemaSpec("s", "1", (FieldSpec("k", multiple=True),)))
    assert [value(r.fields[0]) for r in results.collect()] == [["v1", "v2"]]
    assert [tuple(r) for r in errors.collect()] == [("bad", "protocol_version or sdk_version is required")]
    ir = assemble.from_normalized(docs.where("doc_id = 'd'"))
    assert ir.first().metadata.extra == {"ingest_mode": "mine", "protocol_version": "1"}
    prefixes = assemble.incremental_documents(ir)
    found = prefixes.withColumn("doc_id", F.concat_ws("|", "doc_id", "prefix_pages"))
    fields = extract(found, SchemaSpec("s", "1", (FieldSpec("k", multiple=True),))).select(F.split("doc_id", r"\|")[1].cast("int").alias("p"), F.explode("fields").alias("f"))
    deltas = incremental.changes(fields.select(F.lit("t").alias("task"), "p", "f.key", F.col("f.value_json").alias("v"), "f.evidences"), ["task"], "key", ["p"], "v")
    assert [(r.revision, r.v) for r in deltas.orderBy("revision").collect()] == [(1, '["v1"]'), (2, '["v1","v2"]')]


def test_vision(spark):
    heat = np.zeros((5, 10), "f4")
    heat[1:3, 1:4], heat[2:4, 7:9], heat[0, 9] = 0.9, 0.6, 0.9
    assert [(x1, y1, x2, y2, n) for x1, y1, x2, y2, _, n in vision.components(heat, 0.5, 2, 2.0)] == [(2, 2, 8, 6, 6), (14, 4, 18, 8, 4)]
    assert vision.blank_index(4, 3) == 0 and vision.blank_index(3, 3) == 2
    with pytest.raises(ValueError):
        vision.blank_index(9, 3)
    got = spark.range(1).select(aggregates.window_starts(F.lit(10), 4, 1).alias("a"), aggregates.window_starts(F.lit(3), 4, 1).alias("b")).first()
    assert (got.a, got.b) == ([0, 3, 6], [0])


def test_recognition_of_the_fixed_case(spark):
    """Detection, decoding and join of the fixed pipeline case."""
    # The heat map, the scores and the results of that case.
    heat = np.zeros((5, 10), "f4")
    heat[1, 1:4], heat[2, 1:4] = (0.7, 0.8, 0.8), (0.7, 0.9, 0.8)
    heat[2, 7:9], heat[3, 7:9] = (0.6, 0.7), (0.6, 0.8)
    maps = spark.createDataFrame([(1, 5, 10, heat.ravel().tolist())], "id long, height int, width int, values array<float>")
    boxes = vision.detect(maps, 0.5, 2, 20.0).select(F.col("id").alias("image_id"), F.col("position").alias("patch_index"), F.col("confidence").alias("score"), F.struct("x1", "y1", "x2", "y2").alias("bbox"))
    a = [0.9, 0.1, 0.0, 0.0, 0.1, 0.8, 0.1, 0.0, 0.1, 0.7, 0.2, 0.0, 0.8, 0.1, 0.0, 0.0, 0.1, 0.1, 0.7, 0.1]
    b = [0.9, 0.0, 0.0, 0.1, 0.1, 0.1, 0.1, 0.7, 0.8, 0.1, 0.0, 0.1, 0.9, 0.0, 0.0, 0.1]
    logits = spark.createDataFrame([(1, 0, [1, 5, 4], a), (1, 1, [1, 4, 4], b)], "image_id long, patch_index int, shape array<int>, v array<float>")
    tokens = vision.charset("\ufeffA\n\nB\nC\n")
    decoded = logits.withColumn("p", vision.plane(F.col("v"), F.col("shape"), 2)).withColumn("d", vision.decode_ctc(F.col("p.values"), F.col("p.shape")[0], tokens))
    lines, lost = vision.recognized_lines(boxes, decoded.select("image_id", "patch_index", "d.text", "d.confidence"))
    got = [(r.text, round(r.confidence, 4), tuple(r.bbox)) for r in lines.orderBy("patch_index").collect()]
    assert got == [("AB", 0.75, (20.0, 20.0, 80.0, 60.0)), ("C", 0.675, (140.0, 40.0, 180.0, 80.0))] and lost.count() == 0
    bad = decoded.select("image_id", (F.col("patch_index") + 5).alias("patch_index"), "d.text", "d.confidence")
    assert vision.recognized_lines(boxes, bad)[1].count() == 1
    assert spark.range(1).select(vision.decode_ctc(F.array(*(F.lit(0.5) for _ in range(6))), F.lit(1), tokens).alias("x")).first().x is None


def test_model_answers(spark):
    inputs = spark.createDataFrame([("d", "text", "Acme Corp 42\nother line", None, None, None)], INPUT)
    docs = ingest.read_inline(inputs)
    from docweft.operators import models

    answer = {"fields": [{"key": "a", "value": {"x": ["ACME", None, 42]}, "confidence": 2}, {"key": "b", "value": " t ", "evidence": {"text": "free", "page_no": 9}}, {"key": "a", "value": 1}]}
    bad = [{"fields": 3}, [1], {"a": 1, "a_evidence": 5}]
    rows = spark.createDataFrame([("d", json.dumps(x)) for x in [answer, *bad]], "doc_id string, answer string")
    good, errors = models.join_answers(rows, docs, SchemaSpec("s", "1", (FieldSpec("a", "object"), FieldSpec("b"), FieldSpec("c", "array"))))
    f = good.first().fields
    assert value(f[0]) == answer["fields"][0]["value"] and f[0].confidence == 1.0 and len(f[0].evidences) == 1
    assert [(e.page_no, e.text) for e in f[1].evidences] == [(9, "free")] and value(f[2]) == [] and errors.count() == 3
    got = spark.range(1).select(models.snippets(F.lit(json.dumps({"k": [" a ", "", 1.5, True, None, {"q\"": "b\"c"}]}))).alias("s")).first().s
    assert got == ["a", "1.5", "true", 'b"c']


def test_batches_and_cache(spark):
    """A batch fills the cache, the next is answered from it; events carry payloads in order."""
    rows = [("1", "text", "a: x\nb: y", None, None, None), ("2", "text", "a: x\nb: y", None, None, None), ("3", "text", " ", None, None, None)]
    inputs = spark.createDataFrame(rows, INPUT)
    schema = SchemaSpec("s", "1", (FieldSpec("a"),))
    first = engine.run_batch(inputs, schema, now_ms=1)
    state = {r.task_id: (r.status, r.cached, r.message) for r in first.tasks.collect()}
    assert state == {"1": ("succeeded", False, None), "2": ("succeeded", True, "cache hit (hit_count=1, created_at_ms=1)"), "3": ("failed", False, "content is required")}
    log = {}
    for r in first.events.orderBy("task_id", "sequence").collect():
        log.setdefault(r.task_id, []).append((r.event_type, json.loads(r.payload)))
    assert [k for k, _ in log["1"]] == ["task.accepted", "stage.changed", "document.ready", "page.parsed", "stage.changed", "result.partial", "block.extracted", "stage.changed", "result.snapshot", "completed"]
    assert [k for k, _ in log["2"]] == ["task.accepted", "cache.hit", "result.partial", "result.snapshot", "completed"] and log["2"][1][1]["hit_count"] == 1
    assert [k for k, _ in log["3"]] == ["task.accepted", "stage.changed", "failed"] and log["3"][2][1] == {"message": "content is required"}
    assert log["1"][5][1]["field"]["value"] == "x" and log["1"][6][1]["evidence_count"] == 1 and log["2"][4][1]["result"]["task_id"] == "2"
    second = engine.run_batch(inputs.where("doc_id = '2'"), schema, cache=first.cache, now_ms=9)
    assert [(r.cached, r.message) for r in second.tasks.collect()] == [(True, "cache hit (hit_count=2, created_at_ms=1)")]
    assert [(r.hit_count, r.last_accessed_at_ms) for r in second.cache.collect()] == [(2, 9)]


def test_requests_and_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    lines = [{"task_id": "1", "mode": "async", "kind": "text", "content": "a: b"}, {"task_id": "2", "kind": "url", "url": " "}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, lines)))
    out = f"file://{tmp_path}/out"
    schema = SchemaSpec("s", "1", (FieldSpec("a"),))
    tasks.run_tasks(spark, f"file://{inbox}", out, schema).awaitTermination()
    (inbox / "2.json").write_text(json.dumps(lines[0] | {"task_id": "3"}))
    tasks.run_tasks(spark, f"file://{inbox}", out, schema).awaitTermination()
    state = {r.task_id: (r.status, r.message) for r in tasks.tasks(spark, out).collect()}
    assert state.pop("3")[1].startswith("cache hit (hit_count=1, created_at_ms=")
    assert state == {"1": ("succeeded", None), "2": ("failed", "url is required")}
    log = tasks.events(spark, out)
    assert [r.event_type for r in log.where("task_id = '1'").orderBy("sequence").collect()][:3] == ["task.accepted", "stage.changed", "stage.changed"]
    assert tasks.ended(log).count() == 3
    (inbox / "3.json").write_text("{broken\n" + json.dumps({"task_id": "4", "kind": "text", "content": "x", "mode": "later"}))
    good, refused = ingest.read_requests(spark, f"file://{inbox}")
    assert good.count() == 2 and sorted(r.error for r in refused.collect()) == ["malformed request", "mode must be sync or async", "url is required"]


def test_pdf_strings():
    assert pdf.page_texts(make_pdf(["f(x) and (g(y)) \\) end\nnext"])) == ["f(x) and (g(y)) ) end\nnext\n"]
    assert pdf.page_texts(make_pdf(["X"]).replace(b"(X) Tj", b"[(a(b)) -20 (c)] TJ /S <</T <FEFF>>> BDC")) == ["a(b)c\n"]
    assert pdf.page_texts(make_pdf(["X"]).replace(b"(X) Tj", b"<4142> Tj")) == ["AB\n"]
    for shown in (b"<0041> Tj", b"[<00> 5 <41>] TJ"):
        with pytest.raises(ValueError, match="no known character"):
            pdf.page_texts(make_pdf(["X"]).replace(b"(X) Tj", shown))


def test_heatmap_takes_all_events(spark, tmp_path):
    from docweft.plans.queries import heatmap_components

    rows = [(1, k, 90.0 if k >= 68 else 0.0) for k in range(70)] + [(2, k, 60.0) for k in range(3)]
    spark.createDataFrame(rows, "user_id long, ts long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.id, r.x1, r.y1, r.x2, r.y2, r.pixels) for r in heatmap_components(spark, str(tmp_path)).collect())
    assert got == [(1, 16.0, 32.0, 24.0, 36.0, 2), (2, 0.0, 0.0, 12.0, 4.0, 3)]
