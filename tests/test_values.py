"""Values normalized to their last level, sizes of WebP images, page slots, answers and documents that miss one another."""

import json
import random

from pyspark.sql import functions as F

from docweft.operators import assemble, models, postprocess
from docweft.operators.extract import EVIDENCE
from docweft.schema import FieldSpec, SchemaSpec
from docweft.sources import ocr
from tests.test_labels import documents


def normal(v):
    if isinstance(v, str):
        return v.strip() or None
    if isinstance(v, list):
        out = []
        for x in map(normal, v):
            if tells(x) and not any(same(x, y) for y in out):
                out.append(x)
        return out
    return {k: normal(x) for k, x in v.items()} if isinstance(v, dict) else v


def same(a, b):
    return type(a) is type(b) and (a == b if not isinstance(a, (list, dict)) else json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True))


def tells(v):
    if isinstance(v, (list, dict)):
        return any(map(tells, v.values() if isinstance(v, dict) else v))
    return v is not None and v != ""


def some(rng, depth):
    if depth and rng.random() < 0.7:
        held = [some(rng, depth - 1) for _ in range(rng.randint(0, 4))]
        return held if rng.random() < 0.5 else dict(zip("abcd", held, strict=False))
    return rng.choice([None, " ", " x ", "x", "", 1, 2, True, False, "　é", 'q"\\'])


def test_normalized_to_the_last_level(spark):
    rng = random.Random(8)
    values = [some(rng, 4) for _ in range(300)]
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=k % 2 == 0)) for k, v in enumerate(values)] + [(999, None)], "k int, v string")
    got = {r.k: r.v for r in rows.select("k", postprocess.normalize_json(F.col("v")).alias("v")).collect()}
    assert got.pop(999) is None and all(json.loads(got[k]) == normal(v) for k, v in enumerate(values))
    numbers = spark.createDataFrame([('[1.50, 1.50, 100000000000000000000, 1E5]',)], "v string")
    assert numbers.select(postprocess.normalize_json(F.col("v")).alias("v")).first().v == "[1.50,100000000000000000000,1E5]"


def test_fields_keep_their_place(spark):
    field = f"array<struct<key:string,value_json:string,items:array<string>,meaningful:boolean,confidence:float,evidences:array<{EVIDENCE}>>>"
    rows = [("d", "raw", [("b", '{"x":[" y","y",{"z":null}]}', None, True, 0.5, []), ("a", '["p","p "]', ['"p"', '"p "'], True, 0.5, [])]), ("e", None, []), ("f", None, None)]
    out = {r.doc_id: r for r in postprocess.normalize_nested(spark.createDataFrame(rows, f"doc_id string, raw_text string, fields {field}")).collect()}
    assert [(f.key, f.value_json, f["items"]) for f in out["d"].fields] == [("b", '{"x":["y"]}', None), ("a", '["p"]', ['"p"'])] and out["d"].raw_text == "raw"
    assert out["e"].fields == [] and not out["f"].fields


def test_rows_that_tell_nothing(spark):
    items = ['{"a":null,"b":[]}', '{"a":"x"}', '{"a":" ","b":{"c":""}}', '{"a":false}', '{"k":null,"a":-1}', '"plain"', '{"a":["\\"q"]}', '[null]']
    df = spark.range(1).select(F.array(*(F.lit(x) for x in items)).alias("i"))
    assert df.select(F.filter("i", lambda x: ~x.substr(1, 1).isin("{", "[") | x.rlike(postprocess.TELLING)).alias("k")).first().k == [items[1], items[3], items[4], items[5], items[6]]


def test_webp_sizes():
    def webp(kind, body):
        return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBP" + kind + len(body).to_bytes(4, "little") + body + bytes(20)

    assert ocr.image_size(webp(b"VP8X", bytes(4) + (399).to_bytes(3, "little") + (299).to_bytes(3, "little"))) == (400, 300)
    assert ocr.image_size(webp(b"VP8L", b"\x2f" + ((399) | (299 << 14)).to_bytes(4, "little"))) == (400, 300)
    assert ocr.image_size(webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + (400).to_bytes(2, "little") + (300).to_bytes(2, "little"))) == (400, 300)
    assert ocr.image_size(webp(b"VP8L", bytes(9))) is None


def test_the_last_of_equal_pages_stays(spark):
    rows = spark.createDataFrame([("d", 3, 0, "x"), ("d", 1, 1, "old"), ("d", 1, 2, "new")], "doc_id string, page_no int, n int, text string")
    out = assemble.page_slots(rows, ["doc_id"], "page_no", order="n").orderBy("page_no").collect()
    assert [(r.page_no, r.text) for r in out] == [(1, "new"), (2, None), (3, "x")]


def test_answers_and_documents_that_miss_one_another(spark):
    docs = documents(spark, [("a", [["x"]]), ("b", [["y"]])])
    answers = spark.createDataFrame([("a", '{"k":"v"}'), ("c", '{"k":"w"}')], "doc_id string, answer string")
    good, bad = models.join_answers(answers, docs, SchemaSpec("s", "1", (FieldSpec("k"),)))
    assert [(r.doc_id, r.fields[0].value_json) for r in good.collect()] == [("a", '"v"')]
    assert {r.doc_id: r.error for r in bad.collect()} == {"b": "document without an answer", "c": "answer without a document"}
    given = models.string_inputs(docs, SchemaSpec("s", "1", (FieldSpec("k"),))).orderBy("doc_id").first()
    assert given.plain_text == "x" and SchemaSpec.from_json(given.schema_json).fields == (FieldSpec("k"),)
