"""OCR results: the worker's nested answer as flat lines, blocks and pages, normalised; providers and fallback."""

from __future__ import annotations

import http.client
import json
import struct
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators.assemble import BBOX, PAGE, block_id, merge_extra, plain_text

LINE = f"struct<page_no:int,block_id:string,text:string,bbox:{BBOX},confidence:float>"
BLOCK = f"struct<block_id:string,page_no:int,text:string,bbox:{BBOX},confidence:float,line_count:int>"
_OBSERVED = "request_id:string,timing_ms:bigint,warnings:array<string>"
WORKER = (
    f"struct<{_OBSERVED},provider:string,model:string,blocks:array<{BLOCK}>,lines:array<{LINE}>,pages:array<struct<page_no:int,width:float,height:float,rotation_degrees:float,{_OBSERVED},"
    f"blocks:array<struct<block_id:string,text:string,bbox:{BBOX},confidence:float,line_count:int,lines:array<{LINE}>>>>>>"
)


def _page_of(p: Column) -> Column:
    return F.greatest(F.coalesce(p["page_no"], F.lit(1)), F.lit(1))


def _synthetic(page: Column, i: Column) -> Column:
    """The id of a block that has none, from its page, where it has one, and its place."""
    return F.concat(F.lit("ocr-"), F.coalesce(F.concat(F.lit("p"), page.cast("string"), F.lit("-")), F.lit("")), F.lit("b"), (i + 1).cast("string"))


def nested_blocks(pages: Column) -> Column:
    """Blocks of a worker's pages with their page; a block without text has that of its lines."""

    def of_page(p: Column) -> Column:
        def block(b: Column, i: Column) -> Column:
            lines = F.coalesce(b["lines"], F.array().cast(f"array<{LINE}>"))
            texts = F.filter(F.transform(lines, lambda x: T.utrim(x["text"])), lambda t: t != "")
            own = F.coalesce(T.utrim(b["text"]), F.lit(""))
            return F.struct(
                F.coalesce(T.blank_to_null(b["block_id"]), _synthetic(_page_of(p), i)).alias("block_id"),
                _page_of(p).alias("page_no"),
                F.when(own == "", F.array_join(texts, "\n")).otherwise(own).alias("text"),
                b["bbox"].alias("bbox"),
                b["confidence"].alias("confidence"),
                F.coalesce(b["line_count"], F.nullif(F.size(lines), F.lit(0))).alias("line_count"),
            )

        return F.transform(F.coalesce(p["blocks"], F.array()), block)

    return F.flatten(F.transform(pages, of_page))


def nested_lines(pages: Column) -> Column:
    """Lines of a worker's pages with the page and block that hold them."""

    def of_block(p: Column, b: Column, i: Column) -> Column:
        block = F.coalesce(T.blank_to_null(b["block_id"]), _synthetic(_page_of(p), i))
        return F.transform(
            F.coalesce(b["lines"], F.array()),
            lambda x: F.struct(
                F.greatest(F.coalesce(x["page_no"], _page_of(p)), F.lit(1)).alias("page_no"),
                F.coalesce(T.blank_to_null(x["block_id"]), block).alias("block_id"),
                x["text"].alias("text"),
                x["bbox"].alias("bbox"),
                x["confidence"].alias("confidence"),
            ),
        )

    return F.flatten(F.transform(pages, lambda p: F.flatten(F.transform(F.coalesce(p["blocks"], F.array()), lambda b, i: of_block(p, b, i)))))


def normalize_warnings(warnings: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(warnings, F.array().cast("array<string>")), T.utrim), lambda w: w != ""))


def normalize_lines(lines: Column) -> Column:
    """Trimmed lines that are not blank; pages above 0 or null."""
    clean = F.transform(
        lines,
        lambda x: F.struct(
            F.when(x["page_no"] > 0, x["page_no"]).alias("page_no"), T.blank_to_null(x["block_id"]).alias("block_id"), T.utrim(x["text"]).alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence")
        ),
    )
    return F.filter(clean, lambda x: x["text"] != "")


def normalize_blocks(blocks: Column, lines: Column) -> Column:
    """Trimmed blocks that are not blank, with the number of their lines; without any blocks, one for each line."""

    def one(b: Column, i: Column) -> Column:
        page = F.when(b["page_no"] > 0, b["page_no"])
        block_id = F.coalesce(T.blank_to_null(b["block_id"]), _synthetic(page, i))
        linked = F.nullif(F.size(F.filter(lines, lambda x: x["block_id"] == block_id)), F.lit(0))
        return F.struct(
            block_id.alias("block_id"), page.alias("page_no"), T.utrim(b["text"]).alias("text"), b["bbox"].alias("bbox"), b["confidence"].alias("confidence"), F.coalesce(b["line_count"], linked).alias("line_count")
        )

    return F.when(F.size(blocks) > 0, F.filter(F.transform(blocks, one), lambda b: b["text"] != "")).otherwise(blocks_from_lines(lines))


def normalize_pages(pages: Column, request_id: Column, timing_ms: Column, warnings: Column) -> Column:
    """Pages in order, the first of equal numbers; sizes above 0 or null. A single page inherits what the answer says as a whole."""
    positive = lambda x: F.when(x > 0, x)
    alone = F.size(pages) == 1
    own = lambda p: normalize_warnings(p["warnings"])
    clean = F.transform(
        pages,
        lambda p: F.struct(
            p["page_no"].alias("page_no"),
            positive(p["width"]).alias("width"),
            positive(p["height"]).alias("height"),
            p["rotation_degrees"].alias("rotation_degrees"),
            F.coalesce(T.blank_to_null(p["request_id"]), F.when(alone, T.blank_to_null(request_id))).alias("request_id"),
            F.coalesce(positive(p["timing_ms"]), F.when(alone, positive(timing_ms))).alias("timing_ms"),
            F.when(alone & (F.size(own(p)) == 0), normalize_warnings(warnings)).otherwise(own(p)).alias("warnings"),
        ),
    )
    first = T.keep_first(F.filter(clean, lambda p: p["page_no"] > 0), lambda p: p["page_no"])
    return F.array_sort(first, lambda a, b: a["page_no"] - b["page_no"])


def blocks_from_lines(lines: Column) -> Column:
    """A block for each line, for answers without blocks."""
    return F.transform(
        lines,
        lambda x, i: F.struct(
            F.coalesce(x["block_id"], _synthetic(x["page_no"], i)).alias("block_id"),
            x["page_no"].alias("page_no"),
            x["text"].alias("text"),
            x["bbox"].alias("bbox"),
            x["confidence"].alias("confidence"),
            F.lit(1).alias("line_count"),
        ),
    )


def parse_answers(answers: DataFrame, json_col: str = "answer") -> DataFrame:
    """Worker answers (JSON text) with pages, blocks, lines, warnings, request_id, timing_ms, provider and model.

    Blocks and lines that stand beside the pages win over those inside; an
    answer without pages has one page of the prepared image (``probed``: width and height), if it is known.
    """
    probed = F.col("probed") if "probed" in answers.columns else F.lit(None).cast("struct<width:float,height:float>")
    got = answers.withColumn("__a", F.from_json(json_col, WORKER)).withColumn("__probed", probed)
    a = F.col("__a")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    none = F.lit(None)
    raw_page = lambda p: F.struct(_page_of(p).alias("page_no"), *(p[x].alias(x) for x in ("width", "height", "rotation_degrees", "request_id", "timing_ms", "warnings")))
    only = F.struct(
        F.lit(1).alias("page_no"), F.col("__probed.width").alias("width"), F.col("__probed.height").alias("height"), none.cast("float").alias("rotation_degrees"),
        none.cast("string").alias("request_id"), none.cast("bigint").alias("timing_ms"), none.cast("array<string>").alias("warnings"),
    )
    step = got.select(
        *answers.columns,
        "__a",
        F.when(empty(a["pages"]), F.array(only)).otherwise(F.transform(a["pages"], raw_page)).alias("__pages"),
        F.when(empty(a["blocks"]), F.coalesce(nested_blocks(a["pages"]), F.array().cast(f"array<{BLOCK}>"))).otherwise(a["blocks"]).alias("__blocks"),
        normalize_lines(F.when(empty(a["lines"]), F.coalesce(nested_lines(a["pages"]), F.array().cast(f"array<{LINE}>"))).otherwise(a["lines"])).alias("lines"),
    )
    return step.select(
        *answers.columns,
        normalize_pages(F.col("__pages"), a["request_id"], a["timing_ms"], a["warnings"]).alias("pages"),
        normalize_blocks(F.col("__blocks"), F.col("lines")).alias("blocks"),
        "lines",
        normalize_warnings(a["warnings"]).alias("warnings"),
        T.blank_to_null(a["request_id"]).alias("request_id"),
        F.when(a["timing_ms"] > 0, a["timing_ms"]).alias("timing_ms"),
        a["provider"].alias("provider"),
        a["model"].alias("model"),
    )


def page_metadata(pages: Column, ocr_pages: Column, lines: Column, chosen: Column) -> Column:
    """The metadata entries of a document's pages: rotation, request, timing and warnings where the answer has them, counts always."""
    on = lambda x, page: F.coalesce(x["page_no"], F.lit(1)) == page

    def entries(p: Column) -> Column:
        number = p["page_no"]
        seen = F.get(F.filter(ocr_pages, lambda o: o["page_no"] == number), 0)
        warnings = F.coalesce(seen["warnings"], F.array().cast("array<string>"))
        values = {
            "rotation_degrees": T.whole_text(seen["rotation_degrees"]),
            "request_id": seen["request_id"],
            "timing_ms": seen["timing_ms"].cast("string"),
            "warning_count": F.when(F.size(warnings) > 0, F.size(warnings).cast("string")),
            "line_count": F.size(F.filter(lines, lambda x: on(x, number))).cast("string"),
            "block_count": F.size(F.filter(chosen, lambda x: on(x, number))).cast("string"),
        }
        key = lambda name: F.concat(F.lit("ocr_page_"), number.cast("string"), F.lit("_"), name)
        fixed = F.filter(F.array(*(F.struct(key(F.lit(k)).alias("key"), v.alias("value")) for k, v in values.items())), lambda e: e["value"].isNotNull())
        told = F.transform(warnings, lambda w, i: F.struct(key(F.concat(F.lit("warning_"), (i + 1).cast("string"))).alias("key"), w.alias("value")))
        return F.concat(fixed, told)

    return F.map_from_entries(F.flatten(F.transform(pages, entries)))


def documents(parsed: DataFrame, source_type: str, provider: str, transport: str, page_count: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Documents of parsed answers (doc_id, file_name, mime_type beside what :func:`parse_answers` adds).

    Blocks keep their ids, boxes and confidences; pages have the sizes that the
    answer gives. Blocks are grouped by page, and pages numbered by their order;
    with ``page_count`` empty pages are added up to it.
    """
    as_block = lambda x: F.struct(x["page_no"].alias("page_no"), x["block_id"].alias("block_id"), x["text"].alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence"))
    chosen = F.when(F.size("blocks") > 0, F.transform("blocks", as_block)).otherwise(F.transform("lines", as_block))
    on = lambda x: F.greatest(F.coalesce(x["page_no"], F.lit(1)), F.lit(1))
    step = parsed.withColumn("__chosen", chosen)
    numbers = F.array_sort(F.array_distinct(F.transform("__chosen", on)))
    slots = F.greatest(F.size("__numbers"), F.lit(1), *([page_count] if page_count is not None else []))
    step = step.withColumn("__numbers", numbers).withColumn("__slots", slots.cast("int"))

    def page(k: Column) -> Column:
        own = F.get(F.col("__numbers"), k - 1)
        size = F.get(F.filter("pages", lambda o: o["page_no"] == k), 0)
        blocks = F.transform(
            F.filter("__chosen", lambda x: (on(x) == own) & (T.utrim(x["text"]) != "")),
            lambda x, i: F.struct(
                F.coalesce(x["block_id"], block_id(F.col("doc_id"), k, i)).alias("block_id"), on(x).alias("page_no"), T.utrim(x["text"]).alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence"), F.lit("ocr").alias("source_kind")
            ),
        )
        return F.struct(k.alias("page_no"), size["width"].alias("width"), size["height"].alias("height"), blocks.alias("blocks"))

    step = step.withColumn("__pages", F.transform(F.sequence(F.lit(1), F.col("__slots")), page))
    told = F.transform("warnings", lambda w, i: F.struct(F.concat(F.lit("ocr_warning_"), (i + 1).cast("string")).alias("key"), w.alias("value")))
    base = {
        "parser_provider": F.lit(f"{source_type}-parser"),
        "ocr_provider": F.coalesce("provider", F.lit(provider)),
        "ocr_model": F.col("model"),
        "ocr_transport": F.lit(transport),
        "ocr_request_id": F.col("request_id"),
        "ocr_timing_ms": F.col("timing_ms").cast("string"),
        "ocr_warning_count": F.when(F.size("warnings") > 0, F.size("warnings").cast("string")),
        **(extra or {}),
    }
    more = F.map_concat(merge_extra(F.lit(None).cast("map<string,string>"), base), page_metadata(F.col("__pages"), F.col("pages"), F.col("lines"), F.col("__chosen")), F.map_from_entries(told))
    own = plain_text(F.col("__pages"))
    text = F.when(own == "", F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).otherwise(own)
    step = step.withColumns({"__more": more, "__text": text})
    return step.select(
        "doc_id",
        F.lit(source_type).alias("source_type"),
        F.col("__pages").cast(f"array<{PAGE}>").alias("pages"),
        F.col("__text").alias("plain_text"),
        F.struct("file_name", "mime_type", F.col("__more").alias("extra")).alias("metadata"),
    )


def gather_pages(parsed: DataFrame, keys: list[str], page: str = "raster_page_no") -> DataFrame:
    """Answers of single pages put together, one row for ``keys``: blocks and lines in page order under the raster's page number.

    The answer's request is that of all pages if they agree, its time their sum,
    its warnings all distinct ones, provider and model the first that are named.
    """
    number = F.greatest(F.col(page), F.lit(1))
    first = F.get(F.col("pages"), 0)
    own = F.struct(
        number.alias("page_no"), first["width"].alias("width"), first["height"].alias("height"), first["rotation_degrees"].alias("rotation_degrees"),
        F.coalesce(first["request_id"], F.col("request_id")).alias("request_id"), F.coalesce(first["timing_ms"], F.col("timing_ms")).alias("timing_ms"),
        F.when(F.size(first["warnings"]) > 0, first["warnings"]).otherwise(F.col("warnings")).alias("warnings"),
    )
    at = lambda c: F.transform(c, lambda x: x.withField("page_no", number))
    rows = parsed.select(*keys, F.struct(F.col(page).alias("n"), own.alias("page"), at("blocks").alias("blocks"), at("lines").alias("lines"), "provider", "model").alias("r"))
    every = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("r"))  # the pages of one document
    pages = F.transform("r", lambda x: x["page"])
    ids = F.array_distinct(F.filter(F.transform(pages, lambda p: p["request_id"]), lambda x: x.isNotNull()))
    times = F.filter(F.transform(pages, lambda p: p["timing_ms"]), lambda x: x.isNotNull())
    named = lambda c: F.get(F.filter(F.transform("r", lambda x: x[c]), lambda x: x.isNotNull()), 0)
    return every.select(
        *keys,
        pages.alias("pages"),
        F.flatten(F.transform("r", lambda x: x["blocks"])).alias("blocks"),
        F.flatten(F.transform("r", lambda x: x["lines"])).alias("lines"),
        F.array_distinct(F.flatten(F.transform(pages, lambda p: p["warnings"]))).alias("warnings"),
        F.when(F.size(ids) == 1, F.get(ids, 0)).alias("request_id"),
        F.when(F.size(times) > 0, F.aggregate(times, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("timing_ms"),
        named("provider").alias("provider"),
        named("model").alias("model"),
    )


def _colons(ddl: str) -> str:
    """Top-level ``name type`` pairs as ``name:type``."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


Provider = Callable[[dict], str]


def placeholder_provider(request: dict) -> str:
    """One synthetic line of low confidence, and a warning."""
    text = f"ocr placeholder: {request.get('file_name') or 'unnamed'}"
    line = {"text": text, "confidence": 0.1}
    return json.dumps({"warnings": ["placeholder ocr"], "pages": [{"page_no": 1, "blocks": [{"text": text, "confidence": 0.1, "lines": [line]}]}]})


def meta_headers(metadata: Column) -> Column:
    """The headers that carry a request's metadata (a map): blank values and keys without a name left out."""
    named = F.transform(F.map_entries(metadata), lambda e: F.struct(T.header_suffix(e["key"]).alias("k"), e["value"].alias("v")))
    kept = F.filter(named, lambda e: e["k"].isNotNull() & (T.utrim(e["v"]) != ""))
    return F.map_from_entries(T.keep_first(F.transform(kept, lambda e: F.struct(F.concat(F.lit("x-ocr-meta-"), e["k"]).alias("key"), e["v"].alias("value"))), lambda e: e["key"]))


def request_headers(request: dict, token: str | None = None) -> dict[str, str]:
    headers = {"content-type": request.get("mime_type") or "application/octet-stream", "x-ocr-request-id": request.get("request_id") or request["doc_id"]}
    for name, key in (("x-file-name", "file_name"), ("x-ocr-source-type", "source_type")):
        if request.get(key):
            headers[name] = request[key]
    page = request.get("page_no_hint")
    if page is not None and page == page and page > 0:
        headers["x-ocr-page-no-hint"] = str(int(page))
    headers |= dict(request.get("headers") or {})
    if token:
        headers["authorization"] = f"Bearer {token}"
    return headers


def http_provider(url: str, timeout_ms: int = 5000, token: str | None = None) -> Provider:
    """A provider that posts a file's bytes to a worker and returns its JSON answer; a Python worker keeps one connection."""
    parts = urllib.parse.urlsplit(url)
    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")

    def ask(request: dict) -> str:
        if url not in _OPEN:
            _OPEN[url] = kind(parts.netloc, timeout=timeout_ms / 1000)
        line = _OPEN[url]
        try:
            line.request("POST", path, body=bytes(request["content"]), headers=request_headers(request, token))
            answer = line.getresponse()
            body = answer.read().decode("utf-8", "replace")
        except (OSError, http.client.HTTPException):
            line.close()
            _OPEN.pop(url, None)
            raise
        if not 200 <= answer.status < 300:
            raise RuntimeError(f"OCR worker returned {answer.status}: {body}")
        return body

    return ask


_OPEN: dict[str, http.client.HTTPConnection] = {}


def with_fallback(primary: Provider, secondary: Provider) -> Provider:
    def ask(request: dict) -> str:
        try:
            return primary(request)
        except Exception as first:
            try:
                return secondary(request)
            except Exception as second:
                raise RuntimeError(f"primary: {first}; fallback: {second}") from second

    return ask


def recognize(files: DataFrame, provider: Provider) -> DataFrame:
    """``files`` (doc_id, content and more) with answer, error and probed size instead of content.

    Rows without content are not sent anywhere and keep their error.
    """
    kept = [c for c in files.columns if c not in ("content", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            answers, errors, sizes = [], [], []
            for request in rows.to_dict("records"):
                answer, error, size = None, request.get("error"), None
                if request["content"] is not None:
                    size = image_size(bytes(request["content"]))
                    try:
                        answer = provider(request)
                    except Exception as e:  # an error row, as for every reader
                        error = f"ocr: {e}"
                answers.append(answer)
                errors.append(error)
                sizes.append(None if size is None else {"width": float(size[0]), "height": float(size[1])})
            yield rows[kept].assign(answer=answers, error=errors, probed=sizes)

    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.mapInPandas(run, f"{fields}, answer string, error string, probed struct<width:float,height:float>")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height that the head of a PNG, GIF, BMP, JPEG or WebP file states; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return abs(width), abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind, little = data[12:16], lambda a, z: int.from_bytes(data[a:z], "little")
        if kind == b"VP8X":
            return little(24, 27) + 1, little(27, 30) + 1
        if kind == b"VP8L" and data[20] == 0x2F:
            return (little(21, 25) & 0x3FFF) + 1, (little(21, 25) >> 14 & 0x3FFF) + 1
        if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
            return little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
        return None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


def raster_error(pages: Column) -> Column:
    """The first rule that raster pages (page_no, content) break; null if they break none."""
    numbers = F.transform(pages, lambda p: p["page_no"])
    return F.coalesce(
        F.when(F.exists(pages, lambda p: F.coalesce(p["page_no"], F.lit(0)) < 1), "pdf raster_pages must use page_no >= 1"),
        F.when(F.exists(pages, lambda p: F.coalesce(F.length(p["content"]), F.lit(0)) == 0), "pdf raster pages must contain non-empty image bytes"),
        F.when(F.size(F.array_distinct(numbers)) < F.size(numbers), "pdf raster_pages contains duplicated page_no"),
    )
