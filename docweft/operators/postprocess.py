"""Normalisation of extracted fields, and what a response shows of them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T


def normalize_strings(values: Column) -> Column:
    """Trimmed values, blanks dropped, distinct in order."""
    return F.array_distinct(F.filter(F.transform(values, T.utrim), lambda v: v != ""))


#: A value inside a JSON text that isn't null, blank or empty.
TELLING = r'[:\[,][ ]*(?:true|false|-?[0-9]|"(?!(?:\\[nrt]|\s)*")(?:[^"\\]|\\.)*"(?!\s*:))'


class _Number(str):
    """A number as it was written."""


def _normal(value):
    if isinstance(value, str) and not isinstance(value, _Number):
        return value.strip(T.WHITE) or None
    if isinstance(value, list):
        kept = {}
        for item in map(_normal, value):
            if _meaningful(item):
                kept.setdefault(_text(item, True), item)
        return list(kept.values())
    return {k: _normal(v) for k, v in value.items()} if isinstance(value, dict) else value


def _meaningful(value) -> bool:
    if isinstance(value, (list, dict)):
        return any(map(_meaningful, value.values() if isinstance(value, dict) else value))
    return value is not None and value != ""


def _text(value, ordered: bool = False) -> str:
    """JSON text; with ``ordered``, members in the order of their keys, to compare by."""
    if isinstance(value, _Number):
        return value
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(v, ordered)}" for k, v in (sorted(value.items()) if ordered else value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_text(v, ordered) for v in value) + "]"
    return json.dumps(value, ensure_ascii=False)


def normalize_json(value: Column) -> Column:
    """JSON texts with strings trimmed, blank ones null, and arrays without what tells nothing and what they hold already, however deep.

    Anything may lie inside anything here, so this runs over Arrow batches; what the
    extraction of labels makes is flat where it isn't given through ``normalize_field``.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        read = lambda t: json.loads(t, parse_int=_Number, parse_float=_Number)
        return pa.array([None if t is None else _text(_normal(read(t))) for t in texts.to_pylist()], pa.string())

    return run.asNondeterministic()(value)


def normalize_nested(results: DataFrame) -> DataFrame:
    """``results`` (doc_id, fields, ...) with the values of all fields normalized to their last level; lists follow their value.

    For answers of models, and for schemas in which lists lie inside objects.
    """
    rows = results.select(*results.columns, F.posexplode_outer("fields").alias("__k", "__f"))
    rows = rows.withColumn("__v", normalize_json(F.col("__f.value_json")))
    listed = F.when(F.col("__v").startswith("["), F.transform(F.variant_get(F.try_parse_json("__v"), "$", "array<variant>"), lambda v: F.coalesce(F.to_json(v), F.lit("null"))))
    field = F.col("__f").withField("value_json", F.col("__v")).withField("items", F.when(F.col("__f.items").isNotNull(), listed))
    changed = F.when(F.col("__f").isNotNull(), field)
    keys = [c for c in results.columns if c != "fields"]
    ordered = F.sort_array(F.collect_list(F.when(F.col("__k").isNotNull(), F.struct(F.col("__k").alias("k"), changed.alias("f")))))
    own = rows.groupBy("doc_id").agg(*(F.any_value(c).alias(c) for c in keys if c != "doc_id"), F.transform(ordered, lambda x: x["f"]).alias("fields"))
    return own.select(*results.columns)


def normalize_evidences(evidences: Column) -> Column:
    """Trimmed texts, sorted block ids, distinct (boxes count), ordered by page and text."""
    clean = F.transform(
        evidences,
        lambda e: F.struct(
            e["page_no"].alias("page_no"), T.utrim(e["text"]).alias("text"), e["bbox"].alias("bbox"), F.array_sort(F.array_distinct(e["source_block_ids"])).alias("source_block_ids")
        ),
    )
    once = F.array_distinct(clean)
    placed = F.transform(once, lambda e, i: F.struct(e["page_no"].alias("p"), e["text"].alias("t"), i.alias("i"), e.alias("e")))
    return F.when(F.size(evidences) > 0, F.transform(F.sort_array(placed), lambda x: x["e"])).otherwise(evidences)


def normalize_field(f: Column) -> Column:
    # rows of objects and lists that tell nothing go; single values always tell something
    telling = F.filter(f["items"], lambda x: ~x.substr(1, 1).isin("{", "[") | x.rlike(TELLING))
    items = F.array_distinct(telling)
    value = F.when(f["items"].isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(f["value_json"])
    low = F.least(F.coalesce(f["confidence"], T.real(0.1)), T.real(0.1))
    return F.struct(
        f["key"].alias("key"),
        value.alias("value_json"),
        items.alias("items"),
        f["meaningful"].alias("meaningful"),
        F.when(f["meaningful"], F.coalesce(f["confidence"], T.real(0.6))).otherwise(low).alias("confidence"),
        normalize_evidences(f["evidences"]).alias("evidences"),
    )


def finalize(results: DataFrame) -> DataFrame:
    return results.withColumn("fields", F.transform("fields", normalize_field)).withColumn("status", F.lit("succeeded"))


def respond(results: DataFrame, return_raw_text: bool = False, return_evidence: bool = False) -> DataFrame:
    """``results`` with what was not asked for left out."""
    if not return_raw_text:
        results = results.withColumn("raw_text", F.lit(None).cast("string"))
    if not return_evidence:
        results = results.withColumn("fields", F.transform("fields", lambda f: f.withField("evidences", F.slice(f["evidences"], F.lit(1), F.lit(0)))))
    return results
