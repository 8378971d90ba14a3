"""Answers of extraction models joined with documents and schemas: evidences by text and by id, fields by key, spans by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.shared import fixed
from docweft.operators.assemble import BBOX, blocks_of
from docweft.operators.extract import DEFAULTS, EVIDENCE, _field, _list, combine, distinct_evidences, evidence_of
from docweft.schema import FieldSpec, SchemaSpec

_NONE = f"array<{EVIDENCE}>"


#: A key, string, number or truth value of a JSON text.
_TOKEN = r'"(?:[^"\\]|\\.)*+":?|-?[0-9][0-9.eE+-]*|true|false'
_SPANS = "array<struct<path:string,start_char:int,end_char:int,confidence:float>>"


def member(document: Column, *path: str) -> Column:
    """The JSON text of a member of a JSON text; SQL null where it is absent."""
    where = "$" + "".join(f"['{p}']" for p in path)
    return F.to_json(F.variant_get(F.try_parse_json(document), where, "variant"))


def elements(document: Column) -> Column:
    """JSON texts of the elements of a JSON array; null for anything else."""
    return F.when(document.startswith("["), F.transform(F.variant_get(F.try_parse_json(document), "$", "array<variant>"), lambda v: F.to_json(v)))


def unquoted(document: Column) -> Column:
    """The text that a JSON string stands for; null for anything else."""
    return F.when(document.startswith('"'), F.variant_get(F.try_parse_json(document), "$", "string"))


def confidence_of(document: Column) -> Column:
    """A confidence from a JSON number or a string that holds one, between 0 and 1; null for anything else."""
    given = F.coalesce(T.utrim(unquoted(document)), F.when(document.rlike("^-?[0-9]"), document)).try_cast("float")
    return F.when(given.isNotNull() & ~F.isnan(given), F.greatest(T.real(0.0), F.least(given, T.real(1.0))))


def snippets(document: Column) -> Column:
    """The values inside a JSON text, in order: trimmed strings that are not blank, numbers and booleans as text."""
    tokens = F.regexp_extract_all(document, F.lit(_TOKEN), F.lit(0))
    values = F.filter(tokens, lambda t: ~t.endswith('":'))
    return F.filter(F.transform(values, lambda t: F.when(t.startswith('"'), T.utrim(unquoted(t))).otherwise(t)), lambda t: t != "")


def evidence_by_text(text: Column, plain: Column, blocks: Column) -> Column:
    """Evidences of the blocks that hold a text, ASCII case aside; of the whole text if no block does, without a page."""

    def find(needle: Column) -> Column:
        lower = T.ascii_lower(needle)
        held = F.transform(F.filter(blocks, lambda b: T.ascii_lower(b["text"]).contains(lower)), evidence_of).cast(_NONE)
        alone = F.struct(F.lit(None).cast("int").alias("page_no"), needle.alias("text"), F.lit(None).cast(BBOX).alias("bbox"), F.array().cast("array<string>").alias("source_block_ids"))
        whole = F.when(T.ascii_lower(plain).contains(lower), F.array(alone).cast(_NONE)).otherwise(F.array().cast(_NONE))
        return F.when(F.coalesce(needle, F.lit("")) == "", F.array().cast(_NONE)).otherwise(T.bind(held, lambda h: F.when(F.size(h) > 0, distinct_evidences(h)).otherwise(whole)))

    return T.bind(T.utrim(text), find)


def evidence_by_ids(ids: Column, blocks: Column) -> Column:
    """Evidences of the blocks that are named, in the document's order: a semi-join on trimmed ids."""
    named = F.transform(ids, T.utrim)
    return T.bind(named, lambda n: distinct_evidences(F.transform(F.filter(blocks, lambda b: F.array_contains(n, b["block_id"])), evidence_of).cast(_NONE)))


def _single(item: Column, plain: Column, blocks: Column) -> Column:
    """Evidences of one item: a string, or an object of text, page_no and source_block_ids."""
    text = T.blank_to_null(unquoted(member(item, "text")))
    page = F.when(member(item, "page_no").rlike("^[0-9]+$"), member(item, "page_no")).try_cast("int")
    ids = F.coalesce(F.filter(F.transform(elements(member(item, "source_block_ids")), unquoted), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    found = F.when(F.size(ids) > 0, evidence_by_ids(ids, blocks)).otherwise(evidence_by_text(F.coalesce(text, F.lit("")), plain, blocks))
    free = F.array(F.struct(page.alias("page_no"), text.alias("text"), F.lit(None).cast(BBOX).alias("bbox"), ids.alias("source_block_ids"))).cast(_NONE)

    def close(held: Column) -> Column:
        said = F.transform(held, lambda e: e.withField("text", F.when(T.utrim(e["text"]) == "", F.coalesce(text, e["text"])).otherwise(e["text"])).withField("page_no", F.coalesce(page, e["page_no"])))
        return F.when(F.size(held) > 0, distinct_evidences(said)).when(text.isNotNull(), free).otherwise(F.array().cast(_NONE))

    return F.when(item.startswith('"'), evidence_by_text(unquoted(item), plain, blocks)).otherwise(T.bind(found, close))


def decode_evidences(document: Column, plain: Column, blocks: Column) -> Column:
    """Evidences of a payload: null, a string, an object, or an array of strings and objects."""
    many = F.flatten(F.transform(elements(document), lambda x: _single(x, plain, blocks)))
    return (
        F.when(document.startswith("["), distinct_evidences(many))
        .when(document.startswith('"') | document.startswith("{"), _single(document, plain, blocks))
        .otherwise(F.array().cast(_NONE))
    )


def evidence_error(document: Column) -> Column:
    """Why a payload can't be decoded; null if it can."""
    fits = lambda x: x.startswith('"') | x.startswith("{")
    bad = F.when(document.startswith("["), F.exists(elements(document), lambda x: ~fits(x))).otherwise(~(fits(document) | (document == "null")))
    return F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit("unsupported evidence payload: "), document))


def _model_field(spec: FieldSpec, value: Column, confidence: Column, payload: Column, plain: Column, blocks: Column) -> Column:
    """A field from a model's value (JSON text or null), confidence and evidence payload (JSON text or null)."""
    default = F.lit(DEFAULTS.get(spec.field_type, "null"))
    inferred = distinct_evidences(F.flatten(F.transform(F.coalesce(snippets(value), F.array().cast("array<string>")), lambda s: evidence_by_text(s, plain, blocks))))
    evidences = F.when(payload.isNotNull(), decode_evidences(payload, plain, blocks)).otherwise(inferred)

    def close(e: Column) -> Column:
        given = F.coalesce(value, default)
        meaningful = F.size(snippets(given)) > 0
        own = T.confidence(meaningful, spec.required, F.size(e) > 0, F.coalesce(F.size(elements(given)), F.lit(0)) > 1)
        return _field(spec.key, given, elements(given), meaningful, F.coalesce(confidence, own), e)

    return T.bind(evidences, close)


def _of_key(key: str):
    return lambda x: unquoted(member(x, "key")) == key


def join_answers(answers: DataFrame, docs: DataFrame, schema: SchemaSpec) -> tuple[DataFrame, DataFrame]:
    """doc_id, fields and raw_text of model answers (doc_id, answer as JSON text), and (doc_id, error).

    Schema fields are the left side: those that an answer lacks have their
    default. An answer is an object with ``fields`` (an array of key, value,
    confidence or score, evidences or evidence) or with the keys themselves
    (``key``, ``key_confidence``, ``key_evidences`` or ``key_evidence``). A document
    without an answer and an answer without a document are errors.
    """
    schema.validate()
    held = docs.select("doc_id", "plain_text", blocks_of(F.col("pages")).alias("__blocks"), F.lit(True).alias("__doc"))
    rows = held.join(answers.select("doc_id", "answer", F.lit(True).alias("__answer")), "doc_id", "full")
    listed = member(F.col("answer"), "fields")
    rows = rows.withColumns({"__ok": F.coalesce(F.to_json(F.try_parse_json("answer")).startswith("{"), F.lit(False)), "__listed": listed, "__items": elements(listed)})
    plain, blocks = F.col("plain_text"), F.col("__blocks")
    rows = rows.withColumns({f"__i{i}": F.get(F.filter("__items", _of_key(spec.key)), 0) for i, spec in enumerate(schema.fields)})
    parts = {}
    for i, spec in enumerate(schema.fields):
        item = F.col(f"__i{i}")
        root = lambda suffix, k=spec.key: member(F.col("answer"), k + suffix)
        of_list = F.col("__items").isNotNull()
        parts[f"__v{i}"] = F.when(of_list, member(item, "value")).otherwise(root(""))
        parts[f"__c{i}"] = F.when(of_list, F.coalesce(confidence_of(member(item, "confidence")), confidence_of(member(item, "score")))).otherwise(confidence_of(root("_confidence")))
        parts[f"__e{i}"] = F.when(of_list, F.coalesce(member(item, "evidences"), member(item, "evidence"))).otherwise(F.coalesce(root("_evidences"), root("_evidence")))
    rows = rows.withColumns(parts)
    error = F.coalesce(
        F.when(F.col("__doc").isNull(), "answer without a document"),
        F.when(F.col("__answer").isNull(), "document without an answer"),
        F.when(~F.col("__ok"), "model answer must be a JSON object"),
        F.when(F.col("__listed").isNotNull() & F.col("__items").isNull(), "`fields` must be an array"),
        *(evidence_error(F.col(f"__e{i}")) for i in range(len(schema.fields))),
    )
    rows = fixed(rows.withColumn("error", error))
    fields = [_model_field(spec, F.col(f"__v{i}"), F.col(f"__c{i}"), F.col(f"__e{i}"), plain, blocks) for i, spec in enumerate(schema.fields)]
    good = rows.where("error is null").select("doc_id", F.array(*fields).alias("fields"), F.col("plain_text").alias("raw_text"))
    return good, rows.where("error is not null").select("doc_id", "error")


def string_inputs(docs: DataFrame, schema: SchemaSpec) -> DataFrame:
    """What a model that takes strings is given: doc_id, plain_text and the schema as JSON."""
    return docs.select("doc_id", "plain_text", F.lit(schema.to_json()).alias("schema_json"))


def span_values(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and its predictions, in order, from spans (doc_id, path, start_char, end_char, confidence) of a text.

    Values are sliced out and trimmed, blank ones dropped; of equal spans of a
    path the most certain stays. Evidences are those of the value.
    """
    once = spans.groupBy("doc_id", "path", "start_char", "end_char").agg(F.max(F.col("confidence").cast("float")).alias("confidence"))
    order = F.struct("path", "start_char", "end_char", "confidence")
    grouped = once.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("__spans"))  # the spans of one document
    rows = docs.select("doc_id", "plain_text", blocks_of(F.col("pages")).alias("__blocks")).join(grouped, "doc_id", "left")
    plain, blocks = F.col("plain_text"), F.col("__blocks")

    def value(s: Column) -> Column:
        raw = T.utrim(T.char_slice(plain, s["start_char"], s["end_char"]))
        alone = F.struct(F.lit(None).cast("int").alias("page_no"), raw.alias("text"), F.lit(None).cast(BBOX).alias("bbox"), F.array().cast("array<string>").alias("source_block_ids"))
        found = evidence_by_text(raw, plain, blocks)
        evidences = T.bind(found, lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(alone).cast(_NONE)))
        return F.struct(s["path"].alias("path"), raw.alias("raw"), s["confidence"].alias("confidence"), evidences.alias("evidences"))

    sliced = F.filter(F.transform(F.coalesce(F.col("__spans").cast(_SPANS), F.array().cast(_SPANS)), value), lambda p: F.coalesce(p["raw"], F.lit("")) != "")
    return rows.select("doc_id", "plain_text", sliced.alias("predictions"))


def _span_leaf(spec: FieldSpec, path: str, predictions: Column) -> Column:
    own = F.filter(predictions, lambda p: p["path"] == path)
    typed = F.filter(
        F.transform(own, lambda p: F.struct(T.coerce_json(p["raw"], spec.field_type).alias("value"), p["confidence"].alias("confidence"), p["evidences"].alias("evidences"))), lambda p: p["value"].isNotNull()
    )
    default = "[]" if spec.field_type == "array" else DEFAULTS.get(spec.field_type, "null")
    empty = _field(spec.key, F.lit(default), F.lit(None), F.lit(False), T.confidence(F.lit(False), spec.required, F.lit(False), F.lit(False)), F.array().cast(_NONE))
    inside = lambda c: F.greatest(T.real(0.0), F.least(c, T.real(1.0)))

    def several(kept: Column) -> Column:
        items = F.transform(kept, lambda p: p["value"])
        total = F.aggregate(kept, T.real(0.0), lambda a, p: (a + p["confidence"]).cast("float"))
        evidences = distinct_evidences(F.flatten(F.transform(kept, lambda p: p["evidences"])))
        return _field(spec.key, _list(items), items, F.lit(True), inside((total / F.size(kept).cast("float")).cast("float")), evidences)

    def best(kept: Column) -> Column:
        last = F.array_max(F.transform(kept, lambda p, i: F.struct(p["confidence"].alias("c"), i.alias("i"))))["i"]
        return T.bind(F.get(kept, last), lambda p: _field(spec.key, p["value"], F.lit(None), F.lit(True), inside(p["confidence"]), distinct_evidences(p["evidences"])))

    if spec.multiple:
        return T.bind(T.keep_first(typed, lambda p: p["value"]), lambda kept: F.when(F.size(kept) > 0, several(kept)).otherwise(empty))
    return T.bind(typed, lambda kept: F.when(F.size(kept) > 0, best(kept)).otherwise(empty))


def span_fields(spans: DataFrame, docs: DataFrame, schema: SchemaSpec) -> DataFrame:
    """doc_id, fields and raw_text from predicted spans: leaves look their predictions up by path (``a::b``)."""
    schema.validate()

    def build(spec: FieldSpec, above: tuple[str, ...]) -> Column:
        here = (*above, spec.key)
        if spec.children:
            return combine(spec, [build(c, here) for c in spec.children], distinct_evidences)
        return _span_leaf(spec, "::".join(here), F.col("predictions"))

    return span_values(spans, docs).select("doc_id", F.array(*(build(f, ()) for f in schema.fields)).alias("fields"), F.col("plain_text").alias("raw_text"))


def suggested_stride(max_length: int) -> int:
    """How many tokens neighbouring windows share."""
    return 0 if max_length <= 1 else min(max_length // 4, 64, max_length - 1)


def prompt_windows(docs: DataFrame, prompts: dict[str, int], max_length: int, specials: int = 3) -> DataFrame:
    """A row for each document, leaf and window: ``docs`` is (doc_id, tokens), ``prompts`` the tokens of each leaf's prompt.

    Only the document side is cut. Windows overlap by the suggested stride,
    halved until it fits; what is missing to ``max_length`` is padding.
    """
    parts = []
    for path, n in sorted(prompts.items()):
        room = max_length - n - specials
        if room <= 0:
            raise ValueError(f"the prompt of {path} leaves no room")
        stride = suggested_stride(max_length)
        while stride >= room:
            stride //= 2
        parts.append(F.struct(F.lit(path).alias("path"), F.lit(n).alias("prompt"), F.lit(room).alias("room"), F.lit(room - stride).alias("step")))
    rows = docs.withColumn("__leaf", F.explode(F.array(*parts)))
    n, room, step = F.size("tokens"), F.col("__leaf.room"), F.col("__leaf.step")
    last = F.when(n > room, F.ceil((n - room) / step).cast("int")).otherwise(0)
    rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    kept = F.slice("tokens", F.col("window") * step + 1, room)
    return rows.select(
        "doc_id", F.col("__leaf.path").alias("path"), "window", (F.col("window") * step).alias("first"), kept.alias("tokens"), (F.lit(max_length - specials) - F.col("__leaf.prompt") - F.size(kept)).alias("padding")
    )
