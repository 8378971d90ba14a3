"""The engine's entry points: extraction from inline inputs, normalized documents and files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.shared import settle, spread_join
from docweft.operators import requests, store
from docweft.operators.assemble import first_error, from_normalized
from docweft.operators.extract import Matched
from docweft.operators.extract import extract as extract_fields
from docweft.operators.incremental import document_events, failure_events, hit_events, partial_events, result_events, sequenced, shown
from docweft.operators.postprocess import finalize, normalize_evidences, normalize_field, normalize_nested, respond
from docweft.schema import SchemaSpec
from docweft.sources import docx, ingest, ocr, pdf


@dataclass(frozen=True)
class EngineConfig:
    return_raw_text: bool = False
    return_evidence: bool = False
    ocr_url: str | None = None
    ocr_timeout_ms: int = 5000
    ocr_token: str | None = None
    #: Gives (page_no, media type, bytes) of each page of a PDF without a text layer; None: the file goes to OCR as it is.
    rasterizer: Callable[[bytes], list[tuple[int, str, bytes]]] | None = None
    #: Stands in for the provider that the address above names.
    ocr_provider: ocr.Provider | None = None

    def ocr_name(self) -> str:
        return "custom-ocr" if self.ocr_provider else "fallback-ocr" if self.ocr_url else "placeholder-ocr"

    def ocr_transport(self) -> str:
        return "composite" if self.ocr_url and not self.ocr_provider else "inproc"

    def provider(self) -> ocr.Provider:
        if self.ocr_provider:
            return self.ocr_provider
        if self.ocr_url:
            return ocr.with_fallback(ocr.http_provider(self.ocr_url, self.ocr_timeout_ms, self.ocr_token), ocr.placeholder_provider)
        return ocr.placeholder_provider


def finalized(results: DataFrame, schema: SchemaSpec) -> DataFrame:
    """Normalized results; lists inside other fields are normalized too, where the schema has any."""
    out = finalize(results)
    return normalize_nested(out) if schema.holds_lists_inside() else out


def _results(docs: DataFrame, schema: SchemaSpec, config: EngineConfig) -> DataFrame:
    return respond(finalized(extract_fields(docs, schema, config.return_evidence), schema), config.return_raw_text, config.return_evidence)


def extract(inputs: DataFrame, schema: SchemaSpec, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """Results of inline inputs (doc_id, source_type, text, url, file_name, mime_type), and (doc_id, error)."""
    error = ingest.input_error(F.col("source_type"), F.col("text"), F.col("url"))
    judged = inputs.withColumn("error", error)
    return _results(ingest.read_inline(judged.where("error is null")), schema, config), judged.where("error is not null").select("doc_id", "error")


def extract_normalized(docs: DataFrame, schema: SchemaSpec, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """Results of normalized documents, and (doc_id, error) of those that break a rule."""
    judged = docs.withColumn("error", first_error(F.col("protocol_version"), F.col("sdk_version"), F.col("plain_text"), F.col("pages")))
    return _results(from_normalized(judged.where("error is null")), schema, config), judged.where("error is not null").select("doc_id", "error")


def read_images(files: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Documents of image files, each sent to the OCR provider once, and (doc_id, error)."""
    sent = files.select("doc_id", "file_name", "mime_type", "source_type", "content", F.lit(None).cast("string").alias("error"))
    rows = settle(ocr.recognize(sent, config.provider()))
    docs = ocr.documents(ocr.parse_answers(rows.where("error is null")), "image", config.ocr_name(), config.ocr_transport())
    return docs, rows.where("error is not null").select("doc_id", "error")


def documents_of(files: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """Documents of files (doc_id, file_name, mime_type, source_type, content, byte_size), each read by its type, and (doc_id, error)."""
    return _documents_of(lambda *kinds: files.where(F.col("source_type").isin(*kinds)), config)


def read_documents(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """Documents of all files below a path, each read by its type, and (doc_id, error).

    Each reader lists the files of its own type by their names and opens no other.
    """
    return _documents_of(lambda *kinds: ingest.read_files(spark, path, *kinds), config)


def _documents_of(files: Callable[..., DataFrame], config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    text = files("text", "html", "markdown").select(
        "*", ingest.payload_text(F.lit(None).cast("string"), F.col("content")).alias("text"), F.lit(None).cast("string").alias("url")
    )
    docs = [ingest.read_inline(text.where("text is not null")), ingest.read_unknown(files("unknown"))]
    errors = [text.where("text is null").select("doc_id", F.lit("not UTF-8").alias("error"))]
    readers = (
        docx.read_docx(files("docx")),
        read_images(files("image"), config),
        pdf.read_pdf(files("pdf"), config.provider(), config.ocr_name(), config.ocr_transport(), config.rasterizer),
    )
    for found, failed in readers:
        docs.append(found)
        errors.append(failed)
    out, bad = docs[0], errors[0]
    for d in docs[1:]:
        out = out.unionByName(d)
    for e in errors[1:]:
        bad = bad.unionByName(e)
    return out, bad


def extract_files(spark: SparkSession, path: str, schema: SchemaSpec, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    docs, errors = read_documents(spark, path, config)
    return _results(docs, schema, config), errors


def finalized_changes(matched: Matched, evidence: bool) -> DataFrame:
    """The fields of a document's page prefixes, where they change, as a response shows them."""
    rows = matched.changes_by_page(evidence)
    return rows.withColumns({"f": normalize_field(F.col("f")), "new": normalize_evidences(F.col("new"))})


@dataclass(frozen=True)
class Outcome:
    """What a batch of requests gives: tasks (latest state), events, the cache as it is afterwards, and the keys it was asked for."""

    tasks: DataFrame
    events: DataFrame
    cache: DataFrame
    asked: DataFrame


@dataclass(frozen=True)
class Solved:
    """What the requests that the cache lacks give: documents, results (doc_id, fields, raw_text), failures and changes by page."""

    docs: DataFrame
    final: DataFrame
    failed: DataFrame
    changed: DataFrame | None = None


def run_batch(
    inputs: DataFrame, schema: SchemaSpec, config: EngineConfig = EngineConfig(), cache: DataFrame | None = None, mode: str = "sync", normalized: bool = False, order: str = "doc_id", now_ms: int = 0
) -> Outcome:
    """Tasks of a batch of inputs (inline, normalized documents, or files with their content), through the cache.

    The key of a request digests its input, the schema and the options. The first
    request of a key that the cache lacks is extracted and stored; all others
    are answered with what is stored, under their own task_id. ``order`` tells which request came first.
    """
    error = (
        first_error(F.col("protocol_version"), F.col("sdk_version"), F.col("plain_text"), F.col("pages"))
        if normalized
        else F.lit(None).cast("string")
        if "content" in inputs.columns
        else ingest.input_error(F.col("source_type"), F.col("text"), F.col("url"))
    )
    columns = [c for c in inputs.columns if c not in ("doc_id", order)]
    options = F.lit(f"{config.return_raw_text} {config.return_evidence}")
    key = store.cache_key(F.struct(*columns), F.lit(schema.to_json()), options)
    judged = settle(inputs.withColumns({"error": error, "cache_key": key, "mode": F.lit(mode)}))

    def solve(missed: DataFrame) -> Solved:
        todo = judged.join(missed, "doc_id", "left_semi")
        failed = judged.limit(0).select("doc_id", "error")
        if normalized:
            docs = from_normalized(todo)
        elif "content" in inputs.columns:
            docs, failed = documents_of(todo, config)
        else:
            docs = ingest.read_inline(todo)
        docs = settle(docs)
        matched = Matched(docs, schema, by_page=True).settled(settle)
        final = settle(respond(finalized(matched.fields(config.return_evidence), schema), config.return_raw_text, config.return_evidence).drop("status"))
        return Solved(docs, final, failed, finalized_changes(matched, config.return_evidence))

    return answered(judged, solve, cache, normalized, order, now_ms, config.return_evidence)


def run_uploads(files: DataFrame, uploads: DataFrame, config: EngineConfig = EngineConfig(), cache: DataFrame | None = None, order: str = "task_id", now_ms: int = 0) -> Outcome:
    """Tasks of upload requests (requests.UPLOAD) for files (path, content, byte_size), each with its own schema, mode and options.

    A file is read once for each name and type that requests give it, however
    many ask for it. Requests that break a rule, name no file that is there, or
    name one that its reader refuses, fail with the reason.
    """
    asked = settle(requests.judged(uploads).withColumns({"doc": F.sha2(F.to_json(F.struct("path", "file_name", "mime_type"), {"ignoreNullFields": "false"}), 256)}))
    name = F.coalesce("file_name", F.element_at(F.split("path", "/"), -1))
    wanted = asked.where("error is null").select("doc", "path", name.alias("file_name"), "mime_type").distinct()
    read = wanted.join(files.select("path", "content", F.col("byte_size").cast("bigint").alias("byte_size")), "path")
    held = settle(
        read.select(F.col("doc").alias("doc_id"), "file_name", "mime_type", ingest.source_type(F.col("file_name"), F.col("mime_type")).alias("source_type"), "content", "byte_size", F.sha2("content", 256).alias("digest"))
    )
    digests = held.select(F.col("doc_id").alias("doc"), "digest")
    found = spread_join(asked, digests, ["doc"], ["task_id"], how="left")
    missing = F.when(F.col("digest").isNull(), "file not found")
    key = store.cache_key(F.struct("digest", "file_name", "mime_type"), F.col("schema"), F.struct("return_raw_text", "return_evidence"))
    judged = settle(found.withColumns({"doc_id": F.col("task_id"), "error": F.coalesce("error", missing), "cache_key": key}))

    def solve(missed: DataFrame) -> Solved:
        todo = settle(judged.join(missed, "doc_id", "left_semi"))
        docs, failed = documents_of(held.join(todo.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").drop("digest"), config)
        return _solved(todo, settle(docs), settle(failed))

    return answered(judged, solve, cache, False, order, now_ms, True)


def run_requests(asked: DataFrame, cache: DataFrame | None = None, order: str = "task_id", now_ms: int = 0) -> Outcome:
    """Tasks of inline requests (ingest.REQUEST with schema and options), each with its own schema, mode and options.

    An input is read once, however many requests bring it.
    """
    given = requests.judged(asked.withColumn("path", F.lit("")))
    inputs = ("kind", "content", "url", "file_name", "mime_type")
    refused = ingest.input_error(F.col("kind"), F.col("content"), F.col("url"))
    own = store.cache_key(F.struct(*inputs))
    key = store.cache_key(own, F.col("schema"), F.struct("return_raw_text", "return_evidence"))
    judged = settle(given.withColumns({"doc_id": F.col("task_id"), "doc": own, "error": F.coalesce("error", refused), "cache_key": key}))

    def solve(missed: DataFrame) -> Solved:
        todo = settle(judged.join(missed, "doc_id", "left_semi"))
        texts = todo.select(F.col("doc").alias("doc_id"), F.col("kind").alias("source_type"), F.col("content").alias("text"), "url", "file_name", "mime_type").dropDuplicates(["doc_id"])
        return _solved(todo, settle(ingest.read_inline(texts)), judged.limit(0).select("doc_id", "error"))

    return answered(judged, solve, cache, False, order, now_ms, True)


def _solved(todo: DataFrame, docs: DataFrame, failed: DataFrame) -> Solved:
    """What requests (doc_id, doc, nodes, labels, ...; settled, since they are read again and again) give for documents and failures of ``doc``."""
    final = settle(requests.extract_requests(todo.drop("doc_id").withColumnRenamed("doc", "doc_id"), docs).drop("status").withColumnRenamed("task_id", "doc_id"))
    of_task = todo.select(F.col("doc_id").alias("task_id"), F.col("doc").alias("doc_id"))
    per_task = spread_join(of_task, docs, ["doc_id"], ["task_id"]).drop("doc_id").withColumnRenamed("task_id", "doc_id")
    lost = spread_join(of_task, failed, ["doc_id"], ["task_id"]).select(F.col("task_id").alias("doc_id"), "error")
    return Solved(per_task, final, lost)


def _by_mode(rows: DataFrame, tell: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``tell`` of the rows (with their mode) of either mode."""
    later = F.col("mode") == "async"  # a mode that there isn't is told of at once
    both = [tell(rows.where(own), m) for m, own in (("sync", ~later), ("async", later))]
    return both[0].unionByName(both[1])


def answered(judged: DataFrame, solve: Callable[[DataFrame], Solved], cache: DataFrame | None, normalized: bool, order: str, now_ms: int, evidence: bool) -> Outcome:
    """Tasks, events and cache of judged requests (doc_id, error, cache_key, mode, and what orders them).

    Requests of a key whose first request fails while it is read fail with the same reason.
    """
    probed = settle(store.probe(judged.where("error is null").select("doc_id", "cache_key", "mode", *({order} - {"doc_id", "mode"})), cache, [order]))
    solved = solve(probed.where("nth = 0 and not known").select("doc_id"))
    unread = settle(solved.failed.join(probed, "doc_id").select("cache_key", "error"))
    again = spread_join(probed, unread, ["cache_key"], ["doc_id"]).select("doc_id", "error", "mode")
    refused, again = judged.where("error is not null").select("doc_id", "error", "mode"), settle(again)
    failed = refused.unionByName(again)
    final = solved.final
    stored = final.join(probed.select("doc_id", "cache_key"), "doc_id").select("cache_key", F.to_json("fields").alias("fields"), "raw_text")
    read = probed.join(again.select("doc_id"), "doc_id", "left_anti")
    after = settle(store.updated_cache(cache, stored, read, now_ms))
    kind = final.schema["fields"].dataType.simpleString()
    asking = read.where("nth > 0 or known")
    # what is shown of a result is made once for its key, however many ask for it
    wanted = after.join(asking.select("cache_key").distinct(), "cache_key", "left_semi").withColumn("fields", F.from_json("fields", kind))
    held = wanted.select("cache_key", "fields", "raw_text", "created_at_ms", "last_accessed_at_ms", shown(F.col("fields"), F.col("raw_text")).alias("shown"))
    hits = settle(spread_join(asking, held, ["cache_key"], ["doc_id"]).withColumn("hit_count", F.col("nth")))
    misses = solved.docs.join(probed.where("nth = 0 and not known").select("doc_id", "mode"), "doc_id")
    told = [
        _by_mode(misses, lambda rows, mode: document_events(rows, mode, normalized)),
        *([partial_events(solved.docs, solved.changed, evidence)] if solved.changed is not None else []),
        result_events(final),
        hit_events(hits, normalized),
        _by_mode(refused, lambda rows, mode: failure_events(rows, mode, normalized)),
        _by_mode(again, lambda rows, mode: failure_events(rows, mode, normalized, begun=True)),
    ]
    events = told[0]
    for rows in told[1:]:
        events = events.unionByName(rows)
    none = F.lit(None).cast("string")
    message = F.concat(F.lit("cache hit (hit_count="), F.col("hit_count").cast("string"), F.lit(", created_at_ms="), F.col("created_at_ms").cast("string"), F.lit(")"))
    shape = lambda rows, status, said, cached: rows.select(F.col("doc_id").alias("task_id"), F.lit(status).alias("status"), "fields", "raw_text", said.alias("message"), F.lit(cached).alias("cached"))
    empty = failed.select("doc_id", "error", F.lit(None).cast(kind).alias("fields"), none.alias("raw_text"))
    tasks = shape(final, "succeeded", none, False).unionByName(shape(hits, "succeeded", message, True)).unionByName(shape(empty, "failed", F.col("error"), False))
    return Outcome(tasks, sequenced(events).withColumn("created_at_ms", F.lit(now_ms).cast("bigint")), after, read.select("cache_key"))


def engine_info(config: EngineConfig = EngineConfig()) -> dict[str, str]:
    return {"status": "ok", "extractor": "heuristic", "postprocessor": "default", "ocr": "http" if config.ocr_url else "placeholder", "docx": "zip-docx", "pdf": "content-stream-text"}
