"""The extraction compiler: a schema becomes column expressions over documents.

``find_labels`` gives each leaf of the schema its values and the numbers of the
blocks that bear them out; what is built of them stays numbers until the end,
where each field's blocks are looked up once. Every field is a struct of key,
value_json, items (of an array), meaningful, confidence and evidences.

Values and blocks carry the page that completes them, so the fields of a
document's first pages are the fields of the matches up to that page:
``changes_by_page`` gives them for the pages where a field changes, from one
search of the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.labels import find_labels
from docweft.operators.assemble import BBOX, blocks_of
from docweft.schema import FieldSpec, SchemaSpec

EVIDENCE = f"struct<page_no:int,text:string,bbox:{BBOX},source_block_ids:array<string>>"
DEFAULTS = {"object": "{}", "array": "[]"}


def evidence_of(block: Column) -> Column:
    return F.struct(
        block["page_no"].alias("page_no"), block["text"].alias("text"), block["bbox"].alias("bbox"), F.array(block["block_id"]).alias("source_block_ids")
    )


def distinct_evidences(evidences: Column) -> Column:
    """The first of equal page, text and blocks; boxes don't count."""
    return T.keep_first(evidences, lambda e: F.struct(e["page_no"], e["text"], e["source_block_ids"]))


def _field(key: str, value: Column, items: Column, meaningful: Column, confidence: Column, evidences: Column) -> Column:
    return F.struct(
        F.lit(key).alias("key"),
        value.alias("value_json"),
        items.cast("array<string>").alias("items"),
        meaningful.alias("meaningful"),
        confidence.cast("float").alias("confidence"),
        evidences.alias("evidences"),
    )


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    return T.object_json(*pairs)


def _up_to(entries: Column, page: Column | None) -> Column:
    return entries if page is None else F.filter(entries, lambda e: e["page"] <= page)


def _coerced(values: Column, field_type: str) -> Column:
    return F.transform(values, lambda v: F.struct(v["page"].alias("page"), T.coerce_json(v["raw"], field_type).alias("json")))


def leaf(spec: FieldSpec, typed: Column, evs: Column, page: Column | None = None) -> Column:
    """A leaf from its typed values (page, json) and its evidence (page, block), up to a page."""
    values = F.array_distinct(F.transform(_up_to(typed, page), lambda t: t["json"]))
    blocks = F.transform(_up_to(evs, page), lambda e: e["block"])

    def build(values: Column, blocks: Column) -> Column:
        some = F.size(blocks) > 0
        if spec.multiple:
            many = F.size(values) > 1
            return _field(spec.key, _list(values), values, F.size(values) > 0, T.confidence(F.size(values) > 0, spec.required, some, many), blocks)
        first = F.get(values, 0)
        value = F.coalesce(first, F.lit(DEFAULTS.get(spec.field_type, "null")))
        return _field(spec.key, value, F.lit(None), first.isNotNull(), T.confidence(first.isNotNull(), spec.required, some, F.lit(False)), blocks)

    return T.bind(values, lambda v: T.bind(blocks, lambda b: build(v, b)))


def combine(spec: FieldSpec, children: list[Column], distinct=F.array_distinct) -> Column:
    """An object or array of objects from its children's fields, whose evidences are numbers, or else what ``distinct`` takes."""
    keys = [c.key for c in spec.children]

    def close(own: list[Column], evidences: Column, rows: Column) -> Column:
        live = sum((F.when(c["meaningful"], 1).otherwise(0) for c in own), F.lit(0))
        if spec.field_type == "array":
            value, items, meaningful, many = _list(rows), rows, F.size(rows) > 0, F.size(rows) > 1
        else:
            value, items, meaningful, many = _object([(k, c["value_json"]) for k, c in zip(keys, own, strict=True)]), F.lit(None), live > 0, F.lit(False)
        total = T.real(0.0)
        for c in own:
            total = (total + c["confidence"]).cast("float")
        mean = F.greatest(T.real(0.0), F.least((total / live.cast("float")).cast("float"), T.real(0.99)))
        alone = T.confidence(meaningful, spec.required, F.size(evidences) > 0, many)
        return _field(spec.key, value, items, meaningful, F.when(live > 0, mean).otherwise(alone), evidences)

    def zipped(lists: Column) -> Column:
        held = [lists[f"c{i}"] for i in range(len(keys))]
        n = F.greatest(*(F.size(x) for x in held), F.lit(0))
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n),
            lambda i: _object([(k, F.get(x, i)) for k, x in zip(keys, held, strict=True)]),
        )

    def build(row: Column) -> Column:
        own = [row[f"c{i}"] for i in range(len(keys))]
        evidences = distinct(F.concat(*(c["evidences"] for c in own)))
        none = F.array().cast("array<string>")
        lists = F.struct(*(F.coalesce(c["items"], F.when(c["meaningful"], F.array(c["value_json"])).otherwise(none)).alias(f"c{i}") for i, c in enumerate(own)))
        rows = T.bind(lists, zipped) if spec.field_type == "array" else none
        return T.bind(evidences, lambda e: T.bind(rows, lambda r: close(own, e, r)))

    return T.bind(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(children))), build)


def page_texts(pages: Column) -> Column:
    """The plain text of each page."""
    texts = lambda p: F.filter(F.transform(p["blocks"], lambda b: T.utrim(b["text"])), lambda t: t != "")
    return F.transform(pages, lambda p: F.array_join(texts(p), "\n"))


def paged_blocks(pages: Column) -> Column:
    """The blocks of each page as (id, text)."""
    return F.transform(pages, lambda p: F.transform(p["blocks"], lambda b: F.struct(b["block_id"].alias("id"), b["text"].alias("text"))))


class Matched:
    """Documents with the matches of a schema: one search, from which fields are built."""

    def __init__(self, docs: DataFrame, schema: SchemaSpec, by_page: bool = False):
        """With ``by_page`` the texts of the pages are searched, where there are pages, else the whole text."""
        self.schema = schema.validate()
        self.leaves = [spec for _, spec in schema.leaves()]
        whole = F.array(F.col("plain_text"))
        texts = F.when(F.size("pages") > 0, page_texts(F.col("pages"))).otherwise(whole) if by_page else whole
        found = find_labels(texts, paged_blocks(F.col("pages")), [spec.labels() for spec in self.leaves])
        held = docs.select("doc_id", "plain_text", "pages", found.alias("__m"))
        self.rows = held.select("doc_id", "plain_text", "pages", *self._typed(F.col("__m")))

    def _typed(self, found: Column) -> list[Column]:
        out = []
        for k, spec in enumerate(self.leaves):
            typed = _coerced(found[k]["vals"], spec.field_type)
            out += [F.filter(typed, lambda t: t["json"].isNotNull()).alias(f"__t{k}"), found[k]["evs"].alias(f"__e{k}")]
        return out

    def settled(self, keep) -> Matched:
        """The same, with its rows computed once by ``keep``."""
        self.rows = keep(self.rows)
        return self

    def field(self, spec: FieldSpec, page: Column | None = None) -> Column:
        """A field with the numbers of its blocks."""
        if spec.children:
            return combine(spec, [self.field(c, page) for c in spec.children])
        k = next(i for i, own in enumerate(self.leaves) if own is spec)
        return leaf(spec, F.col(f"__t{k}"), F.col(f"__e{k}"), page)

    def numbers(self, spec: FieldSpec) -> list[int]:
        """Numbers of the leaves below a field."""
        if spec.children:
            return [k for c in spec.children for k in self.numbers(c)]
        return [next(i for i, own in enumerate(self.leaves) if own is spec)]

    def fields(self, evidence: bool = True) -> DataFrame:
        """doc_id, fields and raw_text of each document; the blocks of evidences are looked up only if they are asked for, else there are none."""
        built = self.rows.select("doc_id", "plain_text", blocks_of(F.col("pages")).alias("__b"), F.array(*(self.field(f) for f in self.schema.fields)).alias("__f"))
        told = lambda f: bound(f["evidences"], F.col("__b")) if evidence else F.array().cast(f"array<{EVIDENCE}>")
        shown = F.transform("__f", lambda f: f.withField("evidences", told(f)))
        return built.select("doc_id", shown.alias("fields"), F.col("plain_text").alias("raw_text"))

    def changes_by_page(self, evidence: bool = True) -> DataFrame:
        """(doc_id, n, key, prefix_pages, f, n_evidences, new) of field n for the first page and all pages that add to it.

        ``f`` is the field as the pages up to that one give it, without
        evidences if not asked for; ``new`` are the evidences that the page adds.
        """
        out = None
        for n, spec in enumerate(self.schema.fields):
            own = self.numbers(spec)
            entries = F.concat(*(F.transform(f"__{kind}{k}", lambda x: x["page"]) for k in own for kind in "te"))
            evs = F.concat(*(F.col(f"__e{k}") for k in own))
            told = self.rows.withColumns({"__evs": evs, "__p": F.explode(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1)), entries))))})
            p = F.col("__p")
            until = F.array_distinct(F.transform(_up_to(F.col("__evs"), p), lambda e: e["block"]))
            before = F.transform(F.filter("__evs", lambda e: e["page"] < p), lambda e: e["block"])
            held = told.select(
                "doc_id", F.lit(n).alias("n"), F.lit(spec.key).alias("key"), p.alias("prefix_pages"), self.field(spec, p).alias("f"), F.size(until).alias("n_evidences"),
                F.array_except(until, before).alias("new"), blocks_of(F.col("pages")).alias("__b"),
            )
            shown = bound(F.col("f.evidences"), F.col("__b")) if evidence else F.array().cast(f"array<{EVIDENCE}>")
            held = held.withColumns({"f": F.col("f").withField("evidences", shown), "new": bound(F.col("new"), F.col("__b"))}).drop("__b")
            out = held if out is None else out.unionByName(held)
        return out


def bound(numbers: Column, blocks: Column) -> Column:
    """The blocks of some numbers as evidences."""
    return distinct_evidences(F.transform(numbers, lambda k: evidence_of(F.get(blocks, k))))


def extract(docs: DataFrame, schema: SchemaSpec, evidence: bool = True) -> DataFrame:
    """doc_id, fields and raw_text of each document; without evidences if they are not asked for."""
    return Matched(docs, schema).fields(evidence)
