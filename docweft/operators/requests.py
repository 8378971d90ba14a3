"""Requests that bring a schema and options of their own: schemas are rows, so one plan serves any number of them.

A schema text is parsed once, however many requests carry it, into nodes (one
for each field, in the order of the schema, with the number of its parent).
Leaves are searched by the labels of their own row; composite fields are built
level by level from their children, the deepest first. The levels are as many
as the deepest schema has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.labels import find_labels
from docweft.functions.shared import settle, spread_join
from docweft.operators.assemble import blocks_of
from docweft.operators.extract import bound, paged_blocks
from docweft.operators.postprocess import finalize, normalize_nested
from docweft.schema import FieldSpec, SchemaSpec
from docweft.sources.ingest import mode_error

NODE = "struct<no:int,parent:int,depth:int,key:string,field_type:string,required:boolean,multiple:boolean,leaf:int>"
PARSED = f"schema string, schema_error string, nodes array<{NODE}>, labels array<array<string>>"
#: A file that someone asks for: what it is called and said to be, and what to take from it.
UPLOAD = "task_id string, path string, file_name string, mime_type string, mode string, schema string, options string"


def _nodes(fields: tuple[FieldSpec, ...], parent: int, depth: int, nodes: list[tuple], labels: list[list[str]]) -> None:
    for f in fields:
        no = len(nodes)
        leaf = None if f.children else len(labels)
        nodes.append((no, parent, depth, f.key, f.field_type, f.required, f.multiple, leaf))
        if f.children:
            _nodes(f.children, no, depth + 1, nodes, labels)
        else:
            labels.append(f.labels())


def parse_schemas(schemas: DataFrame) -> DataFrame:
    """PARSED rows of distinct schema texts; one that breaks a rule has the rule as its error and no nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["schema"]:
                nodes: list[tuple] = []
                labels: list[list[str]] = []
                error = None
                try:
                    _nodes(SchemaSpec.from_json(text).validate().fields, -1, 0, nodes, labels)
                except ValueError as e:
                    # a JSON error is a ValueError too; its text tells only of places in the text
                    error = "malformed schema" if isinstance(e, json.JSONDecodeError) else str(e)
                except (KeyError, TypeError, AttributeError):
                    error = "malformed schema"
                out.append((text, error, None if error else nodes, None if error else labels))
            yield pd.DataFrame(out, columns=["schema", "schema_error", "nodes", "labels"])

    return schemas.select("schema").mapInPandas(run, PARSED)


def judged(uploads: DataFrame) -> DataFrame:
    """Upload requests with their parsed schema, their options and the first reason to refuse them (``error``, else null).

    They are settled first: their schemas, the count of hot ones and the join read them again, and they may come as JSON.
    """
    uploads = settle(uploads)
    given = uploads.where(F.col("schema").isNotNull()).select("schema").distinct()
    parsed = parse_schemas(given)
    options = F.try_parse_json("options")
    flag = lambda name: F.coalesce(F.try_variant_get(options, f"$.{name}", "boolean"), F.lit(False))
    of_object = F.schema_of_variant(options).startswith("OBJECT")
    rows = spread_join(uploads, parsed, ["schema"], ["task_id"], how="left")
    error = (
        F.when(F.col("schema").isNull(), "multipart field `schema` is required")
        .when(F.col("path").isNull(), "multipart field `file` is required")
        .when(F.col("schema_error") == "malformed schema", F.col("schema_error"))
        .when(mode_error(F.col("mode")).isNotNull(), mode_error(F.col("mode")))
        .when(F.col("options").isNotNull() & ~F.coalesce(of_object, F.lit(False)), "malformed options")
        .otherwise(F.col("schema_error"))
    )
    mode = F.coalesce(T.utrim(F.col("mode")), F.lit("sync"))
    return rows.select(
        *(c for c in uploads.columns if c not in ("mode", "options")), mode.alias("mode"), "nodes", "labels", flag("return_raw_text").alias("return_raw_text"), flag("return_evidence").alias("return_evidence"), error.alias("error")
    )


def typed_json(raw: Column, field_type: Column) -> Column:
    return F.when(field_type == "number", T.number_json(raw)).when(field_type == "boolean", T.boolean_json(raw)).otherwise(T.coerce_json(raw, "string"))


def _confidence(meaningful: Column, required: Column, some: Column, many: Column) -> Column:
    return F.when(required, T.confidence(meaningful, True, some, many)).otherwise(T.confidence(meaningful, False, some, many))


FIELD = "struct<key:string,value_json:string,items:array<string>,meaningful:boolean,confidence:float,evidences:array<int>>"


def _field(key: Column, value: Column, items: Column, meaningful: Column, confidence: Column, evidences: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value_json"), items.alias("items"), meaningful.alias("meaningful"), confidence.alias("confidence"), evidences.alias("evidences")).cast(FIELD)


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def leaf_fields(rows: DataFrame) -> DataFrame:
    """(task_id, node, field) of the leaves of ``rows`` (task_id, nodes, matches)."""
    leaves = F.filter("nodes", lambda n: n["leaf"].isNotNull())
    pairs = rows.select("task_id", F.explode(F.arrays_zip(leaves.alias("n"), F.col("matches").alias("m"))).alias("x")).select("task_id", F.col("x.n").alias("node"), F.col("x.m").alias("m"))
    typed = F.transform("m.vals", lambda v: typed_json(v["raw"], F.col("node.field_type")))
    held = pairs.select(
        "task_id", "node", F.array_distinct(F.filter(typed, lambda v: v.isNotNull())).alias("v"), F.array_distinct(F.transform("m.evs", lambda e: e["block"])).alias("e")
    )
    n, v, e = F.col("node"), F.col("v"), F.col("e")
    some = F.size(e) > 0
    many = _field(n["key"], _list(v), v, F.size(v) > 0, _confidence(F.size(v) > 0, n["required"], some, F.size(v) > 1), e)
    first = F.get(v, 0)
    default = F.when(n["field_type"] == "object", "{}").when(n["field_type"] == "array", "[]").otherwise("null")
    one = _field(n["key"], F.coalesce(first, default), F.lit(None).cast("array<string>"), first.isNotNull(), _confidence(first.isNotNull(), n["required"], some, F.lit(False)), e)
    return held.select("task_id", "node", F.when(n["multiple"], many).otherwise(one).alias("field"))


def _pair(key: Column, value: Column) -> Column:
    return F.concat(T.string_json(key), F.lit(":"), F.coalesce(value, F.lit("null")))


def _object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def composite_field(node: Column, kids: Column) -> Column:
    """An object or array of objects from the fields of its children, in their order."""
    live = F.size(F.filter(kids, lambda k: k["meaningful"]))
    total = F.aggregate(kids, T.real(0.0), lambda a, k: (a + k["confidence"]).cast("float"))
    mean = F.greatest(T.real(0.0), F.least((total / live.cast("float")).cast("float"), T.real(0.99)))
    evidences = F.array_distinct(F.flatten(F.transform(kids, lambda k: k["evidences"])))
    none = F.array().cast("array<string>")
    listed = lambda k: F.coalesce(k["items"], F.when(k["meaningful"], F.array(k["value_json"])).otherwise(none))
    height = F.coalesce(F.array_max(F.transform(kids, lambda k: F.size(listed(k)))), F.lit(0))
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(height, F.lit(1)) - 1), lambda i: i < height)
    is_array = node["field_type"] == "array"

    def rows_of(lists: Column) -> Column:
        return F.transform(numbers, lambda i: _object(F.transform(lists, lambda k: _pair(k["key"], F.get(k["list"], i)))))

    lists = F.transform(kids, lambda k: F.struct(k["key"].alias("key"), listed(k).alias("list")))
    rows = F.when(is_array, T.bind(lists, rows_of))

    def close(rows: Column, evidences: Column) -> Column:
        meaningful = F.when(is_array, F.size(rows) > 0).otherwise(live > 0)
        value = F.when(is_array, _list(rows)).otherwise(_object(F.transform(kids, lambda k: _pair(k["key"], k["value_json"]))))
        alone = _confidence(meaningful, node["required"], F.size(evidences) > 0, is_array & (F.size(rows) > 1))
        return _field(node["key"], value, rows, meaningful, F.when(live > 0, mean).otherwise(alone), evidences)

    return T.bind(F.struct(rows.alias("r"), evidences.alias("e")), lambda x: close(x["r"], x["e"]))


def extract_requests(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """(task_id, fields, raw_text, status) of requests (task_id, doc_id, nodes, labels, return_raw_text, return_evidence) over documents.

    A document that very many requests ask for is spread over tasks, and so
    are the requests of one schema; a document is never sent to more tasks than that takes.
    """
    asked = requests.select("task_id", "doc_id", "nodes", "labels", "return_raw_text", "return_evidence")
    joined = spread_join(asked, docs.select("doc_id", "plain_text", "pages"), ["doc_id"], ["task_id"])
    found = find_labels(F.array("plain_text"), paged_blocks(F.col("pages")), F.col("labels"))
    rows = settle(joined.select("task_id", "nodes", "plain_text", "pages", "return_raw_text", "return_evidence", found.alias("matches")))
    levels = rows.select(F.array_max(F.transform("nodes", lambda n: n["depth"])).alias("d")).agg(F.max("d")).first()[0] or 0
    fields = leaf_fields(rows)
    for depth in range(levels - 1, -1, -1):
        # what lies a level deeper is done; only its parents are made here
        deeper = fields.where(F.col("node.depth") == depth + 1)
        kids = deeper.groupBy("task_id", F.col("node.parent").alias("no")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("node.no").alias("no"), "field"))), lambda k: k["field"]).alias("kids"))
        own = rows.select("task_id", F.explode(F.filter("nodes", lambda n: (n["depth"] == depth) & n["leaf"].isNull())).alias("node"))
        made = own.join(kids.withColumnRenamed("no", "__no"), (own["task_id"] == kids["task_id"]) & (F.col("node.no") == F.col("__no"))).select(own["task_id"], "node", "kids")
        fields = fields.where(F.col("node.depth") <= depth).unionByName(made.select("task_id", "node", composite_field(F.col("node"), F.col("kids")).alias("field")))
    top = fields.where(F.col("node.depth") == 0).groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("node.no").alias("no"), "field"))), lambda f: f["field"]).alias("__f"))
    held = rows.select("task_id", blocks_of(F.col("pages")).alias("__b"), "plain_text", "return_raw_text", "return_evidence").join(top, "task_id")
    numbers = lambda f: F.when(F.col("return_evidence"), f["evidences"]).otherwise(F.array().cast("array<int>"))
    shown = F.transform("__f", lambda f: f.withField("evidences", bound(numbers(f), F.col("__b"))))
    out = finalize(held.select(F.col("task_id").alias("doc_id"), shown.alias("fields"), F.when(F.col("return_raw_text"), F.col("plain_text")).alias("raw_text")))
    return (normalize_nested(out) if levels > 1 else out).withColumnRenamed("doc_id", "task_id")
