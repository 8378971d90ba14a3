"""Documents from blocks: one row holds a document's pages, and these their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.text import utrim

BBOX = "struct<x1:float,y1:float,x2:float,y2:float>"
BLOCK = f"struct<block_id:string,page_no:int,text:string,bbox:{BBOX},confidence:float,source_kind:string>"
PAGE = f"struct<page_no:int,width:float,height:float,blocks:array<{BLOCK}>>"
METADATA = "struct<file_name:string,mime_type:string,extra:map<string,string>>"
DOCUMENT = f"doc_id string, source_type string, pages array<{PAGE}>, plain_text string, metadata {METADATA}"
NORMALIZED = (
    f"source_type string, plain_text string, protocol_version string, sdk_version string, metadata {METADATA}, "
    f"pages array<struct<page_no:int,width:float,height:float,blocks:array<struct<page_no:int,text:string,bbox:{BBOX},confidence:float,source_kind:string>>>>"
)


def block_id(doc_id: Column, page: Column, position: Column) -> Column:
    """An id that depends on the place alone, so that a repeated task gives it again."""
    return F.sha2(F.concat_ws(":", doc_id, page.cast("string"), position.cast("string")), 256)


def blocks_of(pages: Column) -> Column:
    return F.flatten(F.transform(pages, lambda p: p["blocks"]))


def plain_text(pages: Column) -> Column:
    """Trimmed texts of all blocks that are not blank, a line each."""
    texts = F.transform(blocks_of(pages), lambda b: utrim(b["text"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def pages_from_texts(doc_id: Column, page_texts: Column, kind: str) -> Column:
    """Pages from an array of arrays of block texts: blanks dropped, at least one page."""
    empty = F.array().cast("array<string>")
    given = F.when(F.size(page_texts) > 0, page_texts).otherwise(F.array(empty))

    def page(texts: Column, i: Column) -> Column:
        kept = F.filter(F.transform(F.coalesce(texts, empty), utrim), lambda t: t != "")
        blocks = F.transform(
            kept,
            lambda t, k: F.struct(
                block_id(doc_id, i + 1, k).alias("block_id"),
                (i + 1).cast("int").alias("page_no"),
                t.alias("text"),
                F.lit(None).cast(BBOX).alias("bbox"),
                F.lit(None).cast("float").alias("confidence"),
                F.lit(kind).alias("source_kind"),
            ),
        )
        none = F.lit(None).cast("float")
        return F.struct((i + 1).cast("int").alias("page_no"), none.alias("width"), none.alias("height"), blocks.alias("blocks"))

    return F.transform(given, page)


def merge_extra(extra: Column, defaults: dict[str, Column]) -> Column:
    """``extra`` with defaults for keys that it lacks."""
    given = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    if not defaults:
        return given
    more = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), v.cast("string"))))
    kept = F.map_filter(more, lambda k, v: ~F.map_contains_key(given, k) & v.isNotNull())
    return F.map_concat(given, kept)


def document(doc_id: Column, source_type: Column, pages: Column, file_name: Column, mime_type: Column, extra: dict[str, Column]) -> list[Column]:
    """The columns of a document."""
    none = F.create_map().cast("map<string,string>")
    meta = F.struct(file_name.alias("file_name"), mime_type.alias("mime_type"), merge_extra(none, extra).alias("extra"))
    return [doc_id.alias("doc_id"), source_type.alias("source_type"), pages.alias("pages"), plain_text(pages).alias("plain_text"), meta.alias("metadata")]


def documents(rows: DataFrame, doc_id: Column, source_type: Column, pages: Column, file_name: Column, mime_type: Column, extra: dict[str, Column]) -> DataFrame:
    """Rows as documents; the pages are computed once, and their text is taken from them."""
    named = document(doc_id, source_type, pages, file_name, mime_type, extra)
    held = rows.select(*named[:3], named[4])
    return held.select("doc_id", "source_type", "pages", plain_text(F.col("pages")).alias("plain_text"), "metadata")


def from_normalized(docs: DataFrame) -> DataFrame:
    """Normalized documents (a doc_id and the columns of NORMALIZED) as documents."""
    doc_id = F.col("doc_id")

    def page(p: Column, i: Column) -> Column:
        blocks = F.transform(
            F.coalesce(p["blocks"], F.array()),
            lambda b, k: F.struct(
                block_id(doc_id, i + 1, k).alias("block_id"),
                F.coalesce(b["page_no"], p["page_no"]).alias("page_no"),
                b["text"].alias("text"),
                b["bbox"].alias("bbox"),
                b["confidence"].alias("confidence"),
                F.coalesce(b["source_kind"], F.lit("native_text")).alias("source_kind"),
            ),
        )
        return F.struct(p["page_no"].alias("page_no"), p["width"].alias("width"), p["height"].alias("height"), blocks.alias("blocks"))

    extra = merge_extra(F.col("metadata.extra"), {"ingest_mode": F.lit("normalized"), "protocol_version": F.coalesce("protocol_version", F.lit("1"))})
    return docs.select(
        doc_id.cast("string").alias("doc_id"),
        F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        F.transform(F.coalesce("pages", F.array()), page).cast(f"array<{PAGE}>").alias("pages"),
        F.coalesce("plain_text", F.lit("")).alias("plain_text"),
        F.struct(F.col("metadata.file_name").alias("file_name"), F.col("metadata.mime_type").alias("mime_type"), extra.alias("extra")).alias("metadata"),
    )


def first_error(protocol: Column, sdk: Column, text: Column, pages: Column) -> Column:
    """The first rule that a normalized document breaks; null if it breaks none."""
    numbers = F.transform(pages, lambda p: p["page_no"])
    blocks = blocks_of(pages)
    has_block = F.coalesce(F.size(blocks) > 0, F.lit(False))
    strayed = F.exists(pages, lambda p: F.exists(p["blocks"], lambda b: b["page_no"] != p["page_no"]))
    return F.coalesce(
        F.when(protocol.isNull() & sdk.isNull(), "protocol_version or sdk_version is required"),
        F.when(protocol.isNotNull() & (protocol != "1"), "unsupported protocol_version"),
        F.when((F.coalesce(utrim(text), F.lit("")) == "") & ~has_block, "plain_text or blocks are required"),
        F.when(F.exists(numbers, lambda n: n < 1), "page_no must be at least 1"),
        F.when(F.size(F.array_distinct(numbers)) < F.size(numbers), "page_no must be unique"),
        F.when(F.exists(blocks, lambda b: utrim(b["text"]) == ""), "block text is blank"),
        F.when(strayed, "block page_no differs from its page"),
    )


def page_slots(pages: DataFrame, keys: list[str], page_col: str, count: Column | None = None, order: str | None = None) -> DataFrame:
    """A row for each page from 1 to the largest (or ``count``); missing pages are null but for keys and number.

    Of several pages of a number the last by ``order`` stays, where that is given.
    """
    if order is not None:
        others = [c for c in pages.columns if c not in (*keys, page_col)]
        pages = pages.groupBy(*keys, page_col).agg(F.max_by(F.struct(*others), order).alias("__last")).select(*keys, page_col, "__last.*")
    top = F.max(page_col) if count is None else F.greatest(F.max(page_col), F.max(count))
    slots = pages.groupBy(*keys).agg(F.greatest(top, F.lit(1)).alias("__top")).select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__top").cast("long"))).alias(page_col))
    return slots.join(pages.withColumn(page_col, F.col(page_col).cast("long")), [*keys, page_col], "left")


def page_prefixes(pages: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """For each page the text of the pages up to it, joined by line feeds.

    The window is over one document's pages.
    """
    upto = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.filter(F.collect_list(F.when(utrim(F.col(text)) != "", utrim(F.col(text)))).over(upto), lambda t: t.isNotNull())
    return pages.withColumn("prefix_text", F.array_join(kept, "\n"))


def incremental_documents(docs: DataFrame) -> DataFrame:
    """A document for each run of first pages, with its number of pages; documents without pages as they are."""
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size("pages"), F.lit(1))), lambda n: F.struct(n.alias("n"), F.slice("pages", F.lit(1), n).alias("pages")))
    return docs.withColumn("__p", F.explode(upto)).select(
        "doc_id",
        "source_type",
        F.col("__p.pages").alias("pages"),
        F.when(F.size("pages") > 0, plain_text(F.col("__p.pages"))).otherwise(F.col("plain_text")).alias("plain_text"),
        "metadata",
        F.col("__p.n").alias("prefix_pages"),
    )
