"""What changes from one prefix of a document to the next, and the events that tell of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text as T

TERMINAL = ("completed", "failed")


def changes(rows: DataFrame, group: list[str], key: str, position: list[str], value: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose value, or one of the columns ``also``, differs from the key's row before, with revision counted over the group.

    ``previous`` is that row's value, null for a key's first row; ``previous_<column>`` likewise.
    """
    by_key = Window.partitionBy(*group, key).orderBy(*position)
    by_group = Window.partitionBy(*group).orderBy(*position, key)
    marked = rows.withColumn("previous", F.lag(value).over(by_key)).withColumn("__first", F.row_number().over(by_key) == 1)
    for c in also:
        marked = marked.withColumn(f"previous_{c}", F.lag(c).over(by_key))
    same = F.col(value).eqNullSafe(F.col("previous"))
    for c in also:
        same = same & F.col(c).eqNullSafe(F.col(f"previous_{c}"))
    changed = marked.where(F.col("__first") | ~same).drop("__first")
    return changed.withColumn("revision", F.row_number().over(by_group))


def numbered(rows: DataFrame, task: str, order: list) -> DataFrame:
    """Rows with a sequence per task, from 1."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(task).orderBy(*order)))


def text_json(c: Column) -> Column:
    return F.when(c.isNotNull(), T.string_json(c))


def field_json(f: Column, evidence: bool = True) -> Column:
    """A field as JSON: its value as it is, its evidences where they are asked for."""
    shown = T.to_json(f["evidences"]) if evidence else F.lit("[]")
    return T.object_json(("key", text_json(f["key"])), ("value", f["value_json"]), ("confidence", f["confidence"].cast("string")), ("evidences", shown))


def boxes_of(evidences: Column) -> Column:
    """The distinct boxes of evidences, in order."""
    return F.array_distinct(F.filter(F.transform(evidences, lambda e: e["bbox"]), lambda b: b.isNotNull()))


def box_around(boxes: Column) -> Column:
    """The smallest box around all; null if there are none."""
    edge = lambda name, pick: pick(F.transform(boxes, lambda b: b[name]))
    all_in = F.struct(edge("x1", F.array_min).alias("x1"), edge("y1", F.array_min).alias("y1"), edge("x2", F.array_max).alias("x2"), edge("y2", F.array_max).alias("y2"))
    return F.when(F.size(boxes) > 0, all_in)


def _boxes(evidences: Column) -> list[tuple[str, Column]]:
    boxes = boxes_of(evidences)
    return [("bbox", T.to_json(box_around(boxes))), ("bboxes", T.to_json(boxes))]


def page_value(extra: Column, page: Column, name: str) -> Column:
    """What the metadata say of a page."""
    return F.try_element_at(extra, F.concat(F.lit("ocr_page_"), page.cast("string"), F.lit(f"_{name}")))


def page_warnings(extra: Column, page: Column) -> Column:
    """Warnings of a page, those of the document where it has none of its own."""
    n = F.coalesce(page_value(extra, page, "warning_count").try_cast("int"), F.try_element_at(extra, F.lit("ocr_warning_count")).try_cast("int"), F.lit(0))
    one = lambda i: F.coalesce(
        F.try_element_at(extra, F.concat(F.lit("ocr_page_"), page.cast("string"), F.lit("_warning_"), i.cast("string"))), F.try_element_at(extra, F.concat(F.lit("ocr_warning_"), i.cast("string")))
    )
    return F.filter(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n), one), lambda w: w.isNotNull())


def blocks_preview(page: Column) -> Column:
    """The first five OCR blocks of a page, their texts cut."""
    own = F.slice(F.filter(page["blocks"], lambda b: b["source_kind"] == "ocr"), F.lit(1), F.lit(5))
    return F.transform(
        own, lambda b: F.struct(b["block_id"].alias("block_id"), T.preview(b["text"], 80).alias("text"), F.length(b["text"]).alias("text_chars"), b["bbox"].alias("bbox"), b["confidence"].alias("confidence"))
    )


EVENT = "struct<place:int,page:bigint,part:int,event_type:string,stage:string,payload:string>"


def event(place: int, kind: str, payload: Column, stage: str | None = None, page: Column | None = None, part: int | Column = 0) -> Column:
    """One event of a task; place, page and part order it."""
    return F.struct(
        F.lit(place).alias("place"),
        (F.lit(0) if page is None else page).cast("long").alias("page"),
        (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part"),
        F.lit(kind).alias("event_type"),
        F.lit(stage).cast("string").alias("stage"),
        payload.alias("payload"),
    ).cast(EVENT)


def stage(name: str, place: int, status: str = "running", message: Column | None = None, part: int = 0) -> Column:
    pairs = [("stage", text_json(F.lit(name))), ("status", text_json(F.lit(status)))]
    return event(place, "stage.changed", T.object_json(*pairs, *([("message", text_json(message))] if message is not None else [])), name, part=part)


def page_events(page: Column, extra: Column) -> Column:
    """page.parsed, and page.ocr_done if the page has OCR blocks or counts."""
    number = page["page_no"]
    of_doc = lambda name: F.try_element_at(extra, F.lit(name))
    own = F.size(F.filter(page["blocks"], lambda b: b["source_kind"] == "ocr"))
    blocks, lines = page_value(extra, number, "block_count").try_cast("bigint"), page_value(extra, number, "line_count").try_cast("bigint")
    size = [("page_no", number.cast("string")), ("width", page["width"].cast("string")), ("height", page["height"].cast("string"))]
    chars = F.aggregate(page["blocks"], F.lit(0), lambda a, b: a + F.length(b["text"]))
    parsed = event(5, "page.parsed", T.object_json(*size, ("block_count", F.size(page["blocks"]).cast("string")), ("text_chars", chars.cast("string"))), page=number)
    done = T.object_json(
        *size,
        ("rotation_degrees", page_value(extra, number, "rotation_degrees").try_cast("float").cast("string")),
        ("ocr_block_count", F.coalesce(blocks, own).cast("string")),
        ("ocr_line_count", lines.cast("string")),
        *((name, text_json(of_doc(name))) for name in ("ocr_provider", "ocr_model", "ocr_transport")),
        ("ocr_request_id", text_json(F.coalesce(page_value(extra, number, "request_id"), of_doc("ocr_request_id")))),
        ("ocr_timing_ms", F.coalesce(page_value(extra, number, "timing_ms"), of_doc("ocr_timing_ms")).try_cast("bigint").cast("string")),
        ("ocr_warnings", T.to_json(page_warnings(extra, number))),
        ("ocr_blocks_preview", T.to_json(blocks_preview(page))),
        *((name, text_json(of_doc(name))) for name in ("pdf_ocr_input", "pdf_raster_provider")),
    )
    seen = (own > 0) | blocks.isNotNull() | lines.isNotNull()
    return F.concat(F.array(parsed), F.when(seen, F.array(event(5, "page.ocr_done", done, page=number, part=1))).otherwise(F.array().cast(f"array<{EVENT}>")))


ACCEPTED = "task has been accepted for background processing"
SKIPPED = "normalized document accepted; parse stage skipped"


def opening(mode: str, normalized: bool) -> list[Column]:
    """What every task begins with."""
    said = T.object_json(("mode", text_json(F.lit(mode))), ("ingest_mode", text_json(F.lit("normalized" if normalized else "parsed"))))
    return [event(0, "task.accepted", said)] + ([stage("queued", 1, "accepted", F.lit(ACCEPTED))] if mode == "async" else [])


def document_events(docs: DataFrame, mode: str = "sync", normalized: bool = False) -> DataFrame:
    """task_id and events of documents (doc_id, source_type, pages, plain_text, metadata) up to the extraction."""
    ready = T.object_json(
        ("page_count", F.size("pages").cast("string")), ("plain_text_chars", F.length("plain_text").cast("string")), ("source_type", text_json(F.col("source_type")))
    )
    first = stage("extracting", 3, message=F.lit(SKIPPED)) if normalized else stage("parsing", 3)
    head = F.array(*opening(mode, normalized), first, event(4, "document.ready", ready))
    pages = F.flatten(F.transform("pages", lambda p: page_events(p, F.col("metadata.extra"))))
    tail = F.array().cast(f"array<{EVENT}>") if normalized else F.array(stage("extracting", 6))
    return docs.select(F.col("doc_id").alias("task_id"), F.explode(F.concat(head, pages, tail)).alias("e")).select("task_id", "e.*")


def partial_events(docs: DataFrame, changed: DataFrame, evidence: bool = False) -> DataFrame:
    """result.partial and block.extracted of every field that changes from one page prefix to the next.

    ``docs`` are documents, ``changed`` the rows of ``Matched.changes_by_page``, their
    fields finalized. New evidences are told whether or not evidences are asked for.
    """
    state = F.struct("f.value_json", "f.confidence", "n_evidences")
    seen = changed.withColumns({"state": state, "__key": F.concat_ws(":", F.lpad(F.col("n").cast("string"), 6, "0"), "key")})
    told = changes(seen, ["doc_id"], "__key", ["prefix_pages"], "state")
    context = docs.select("doc_id", F.col("metadata.extra").alias("__extra"), "pages")
    rows = told.join(context, "doc_id").withColumn("__page", F.get("pages", F.col("prefix_pages") - 1))
    number = F.coalesce(F.col("__page.page_no"), F.lit(1))
    view = [
        ("width", F.col("__page.width").cast("string")), ("height", F.col("__page.height").cast("string")),
        ("rotation_degrees", page_value(F.col("__extra"), number, "rotation_degrees").try_cast("float").cast("string")),
    ]
    shown = F.col("f.evidences") if evidence else F.slice("f.evidences", F.lit(1), F.lit(0))
    revision = F.col("revision").cast("string")
    partial = T.object_json(
        ("cached", F.lit("false")), ("revision", revision), ("field", field_json(F.col("f"), evidence)), *_boxes(shown), ("page_no", number.cast("string")),
        ("pages_processed", F.col("prefix_pages").cast("string")), ("page_count", F.greatest(F.size("pages"), F.lit(1)).cast("string")), *view,
    )
    block = T.object_json(
        ("revision", revision), ("page_no", number.cast("string")), ("field_key", text_json(F.col("key"))), ("field", field_json(F.col("f"), evidence)),
        ("evidence_count", F.size("new").cast("string")),
        ("source_block_ids", T.to_json(F.array_sort(F.array_distinct(F.flatten(F.transform("new", lambda e: e["source_block_ids"])))))),
        ("snippets", T.to_json(F.array_sort(F.array_distinct(F.transform("new", lambda e: e["text"]))))), *_boxes(F.col("new")), *view,
    )
    told = F.array(event(7, "result.partial", partial, page=F.col("revision")))
    extracted = F.when(F.size("new") > 0, F.array(event(7, "block.extracted", block, page=F.col("revision"), part=1))).otherwise(F.array().cast(f"array<{EVENT}>"))
    return rows.select(F.col("doc_id").alias("task_id"), F.explode(F.concat(told, extracted)).alias("e")).select("task_id", "e.*")


def result_json(task_id: Column, fields: Column, raw_text: Column) -> Column:
    listed = F.concat(F.lit("["), F.array_join(F.transform(fields, lambda f: field_json(f)), ","), F.lit("]"))
    return T.object_json(("task_id", text_json(task_id)), ("status", F.lit('"succeeded"')), ("fields", listed), ("raw_text", text_json(raw_text)))


def result_events(results: DataFrame, cached: bool = False) -> DataFrame:
    """result.snapshot and completed of results (doc_id, fields, raw_text); for cached ones a result.partial of each field before."""
    done = result_json(F.col("doc_id"), F.col("fields"), F.col("raw_text"))
    flag = ("cached", F.lit(str(cached).lower()))
    last = [
        event(9, "result.snapshot", T.object_json(flag, ("field_count", F.size("fields").cast("string")), ("result", done))),
        event(10, "completed", T.object_json(flag, ("result", done))),
    ]
    rows = F.array(*last)
    if cached:
        of_field = lambda f, i: event(7, "result.partial", T.object_json(flag, ("revision", (i + 1).cast("string")), ("field", field_json(f)), *_boxes(f["evidences"])), page=i + 1)
        rows = F.concat(F.transform("fields", of_field), rows)
    else:
        rows = F.concat(F.array(stage("postprocessing", 8)), rows)
    return results.select(F.col("doc_id").alias("task_id"), F.explode(rows).alias("e")).select("task_id", "e.*")


def failure_events(failed: DataFrame, mode: str = "sync", normalized: bool = False, begun: bool = False) -> DataFrame:
    """Events of tasks (doc_id, error) that failed: a failed stage, for those that someone waits for, and failed.

    ``begun``: their parsing had begun.
    """
    message = F.col("error")
    said = event(11, "failed", T.object_json(("message", text_json(message))))
    rows = [*opening(mode, normalized), *([stage("parsing", 3)] if begun else []), *([stage("failed", 11, "failed", message, part=-1)] if mode == "sync" else []), said]
    return failed.select(F.col("doc_id").alias("task_id"), F.explode(F.array(*rows)).alias("e")).select("task_id", "e.*")


def cache_events(hits: DataFrame) -> DataFrame:
    """cache.hit of requests (doc_id, cache_key, hit_count, created_at_ms, last_accessed_at_ms)."""
    said = T.object_json(
        ("cache_key", text_json(F.col("cache_key"))), *((n, F.col(n).cast("string")) for n in ("hit_count", "created_at_ms", "last_accessed_at_ms"))
    )
    return hits.select(F.col("doc_id").alias("task_id"), event(2, "cache.hit", said).alias("e")).select("task_id", "e.*")


def shown(fields: Column, raw_text: Column) -> Column:
    """What all answers of a cached result have in common: its fields and raw text as JSON, and the payload of each field's result.partial."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(fields, lambda f: field_json(f)), ","), F.lit("]"))
    partial = lambda f, i: T.object_json(("cached", F.lit("true")), ("revision", (i + 1).cast("string")), ("field", field_json(f)), *_boxes(f["evidences"]))
    return F.struct(listed.alias("fields"), text_json(raw_text).alias("raw_text"), F.transform(fields, partial).alias("partials"))


def hit_events(hits: DataFrame, normalized: bool) -> DataFrame:
    """All events of requests that the cache answers: cached results (doc_id, mode, ``shown`` and what :func:`cache_events` takes), each told in one pass."""
    done = T.object_json(("task_id", text_json(F.col("doc_id"))), ("status", F.lit('"succeeded"')), ("fields", F.col("shown.fields")), ("raw_text", F.col("shown.raw_text")))
    said = T.object_json(("cache_key", text_json(F.col("cache_key"))), *((n, F.col(n).cast("string")) for n in ("hit_count", "created_at_ms", "last_accessed_at_ms")))
    rows = hits.select("doc_id", "mode", "shown.partials", done.alias("done"), said.alias("said"))
    flag = ("cached", F.lit("true"))
    first = F.when(F.col("mode") == "async", F.array(*opening("async", normalized))).otherwise(F.array(*opening("sync", normalized)))
    parts = F.transform("partials", lambda p, i: event(7, "result.partial", p, page=i + 1))
    last = F.array(
        event(9, "result.snapshot", T.object_json(flag, ("field_count", F.size("partials").cast("string")), ("result", F.col("done")))),
        event(10, "completed", T.object_json(flag, ("result", F.col("done")))),
    )
    told = F.concat(first, F.array(event(2, "cache.hit", F.col("said"))), parts, last)
    return rows.select(F.col("doc_id").alias("task_id"), F.explode(told).alias("e")).select("task_id", "e.*")


def sequenced(rows: DataFrame) -> DataFrame:
    """task_id, sequence (from 1), event_type, stage and payload of event rows."""
    return numbered(rows, "task_id", ["place", "page", "part", "event_type"]).select("task_id", "sequence", "event_type", "stage", "payload")
