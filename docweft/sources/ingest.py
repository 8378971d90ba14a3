"""Inputs of all kinds: their type, whether they are valid, and the readers that need no Python."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import ascii_lower, utrim
from docweft.operators.assemble import NORMALIZED, documents, pages_from_texts

REQUEST = "task_id string, mode string, kind string, content string, url string, file_name string, mime_type string"
#: Requests with a schema and options of their own: JSON objects, kept as texts.
FULL_REQUEST = REQUEST + ", schema string, options string"
#: File name endings and their types.
EXTENSIONS = (
    (("pdf",), "pdf"),
    (("docx",), "docx"),
    (("html", "htm"), "html"),
    (("md", "markdown"), "markdown"),
    (("txt",), "text"),
    (("png", "jpg", "jpeg", "webp", "bmp"), "image"),
)
PARSERS = {"text": "text-parser", "html": "text-parser", "markdown": "text-parser", "url": "url-parser", "unknown": "binary-placeholder-parser"}


def source_type(file_name: Column, mime_type: Column) -> Column:
    """The type of an upload: from its media type, else from its name, else unknown."""
    mime = F.coalesce(ascii_lower(mime_type), F.lit(""))
    name = F.coalesce(ascii_lower(file_name), F.lit(""))
    ending = F.when(name.contains("."), F.element_at(F.split(name, r"\.", -1), -1))
    out = (
        F.when(mime.startswith("image/"), "image")
        .when(mime == "application/pdf", "pdf")
        .when(mime.contains("wordprocessingml"), "docx")
        .when(mime == "text/html", "html")
        .when(mime.isin("text/markdown", "text/x-markdown"), "markdown")
        .when(mime.startswith("text/"), "text")
    )
    for endings, kind in EXTENSIONS:
        out = out.when(ending.isin(*endings), kind)
    return out.otherwise("unknown")


def input_error(kind: Column, content: Column, url: Column) -> Column:
    """Why an inline input is refused; null if it isn't."""
    blank = lambda c: F.coalesce(utrim(c), F.lit("")) == ""
    return (
        F.when(kind.isin("text", "html", "markdown") & blank(content), "content is required")
        .when((kind == "url") & blank(url), "url is required")
        .when(~kind.isin("text", "html", "markdown", "url", "image", "pdf", "docx") | kind.isNull(), "unknown kind")
        .when(kind.isin("image", "pdf", "docx"), "bytes are required")
    )


def mode_error(mode: Column) -> Column:
    return F.when(mode.isNotNull() & ~utrim(mode).isin("sync", "async"), "mode must be sync or async")


def payload_text(text: Column, content: Column) -> Column:
    """Text if there is one, else the bytes as UTF-8 (null if they are not), else empty."""
    decoded = F.when(F.is_valid_utf8(content.cast("binary").cast("string")), content.cast("string"))
    return F.when(text.isNotNull(), text).when(content.isNotNull(), decoded).otherwise("")


def placeholder(summary: Column, file_name: Column, mime_type: Column, byte_size: Column) -> Column:
    return F.concat_ws(
        "\n",
        summary,
        F.concat(F.lit("file_name: "), F.coalesce(file_name, F.lit("unnamed"))),
        F.concat(F.lit("mime_type: "), F.coalesce(mime_type, F.lit("unknown"))),
        F.concat(F.lit("byte_size: "), F.coalesce(byte_size, F.lit(0)).cast("string")),
    )


def block_kind(kind: str) -> str:
    return "synthetic" if kind in ("image", "pdf", "docx", "unknown") else "native_text"


def read_inline(inputs: DataFrame) -> DataFrame:
    """Documents of text, HTML, Markdown and address inputs (doc_id, source_type, text, url, file_name, mime_type).

    The whole text is one block; marks are not stripped. Addresses are not fetched.
    """
    text = F.when(F.col("source_type") == "url", F.concat(F.lit("url ingestion placeholder: "), F.col("url"))).otherwise(F.col("text"))
    pages = pages_from_texts(F.col("doc_id"), F.array(F.array(text)), "native_text")
    provider = F.when(F.col("source_type") == "url", PARSERS["url"]).otherwise(PARSERS["text"])
    known = inputs.where(F.col("source_type").isin("text", "html", "markdown", "url"))
    return documents(known, F.col("doc_id"), F.col("source_type"), pages, F.col("file_name"), F.col("mime_type"), {"parser_provider": provider})


def read_unknown(inputs: DataFrame) -> DataFrame:
    """Placeholder documents of inputs (doc_id, file_name, mime_type, byte_size) of unknown type."""
    text = placeholder(F.lit("unsupported input placeholder"), F.col("file_name"), F.col("mime_type"), F.col("byte_size"))
    pages = pages_from_texts(F.col("doc_id"), F.array(F.array(text)), block_kind("unknown"))
    return documents(inputs, F.col("doc_id"), F.lit("unknown"), pages, F.col("file_name"), F.col("mime_type"), {"parser_provider": F.lit(PARSERS["unknown"])})


def read_requests(spark: SparkSession, path: str, columns: str = REQUEST) -> tuple[DataFrame, DataFrame]:
    """JSON requests, a line each: the good ones, and the refused ones with their error. ``columns`` may be FULL_REQUEST."""
    rows = spark.read.schema(columns + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    error = F.coalesce(
        F.when(F.col("_corrupt_record").isNotNull(), "malformed request"), mode_error(F.col("mode")), input_error(F.col("kind"), F.col("content"), F.col("url"))
    )
    judged = rows.withColumn("error", error)
    return judged.where("error is null").drop("error", "_corrupt_record"), judged.where("error is not null").drop("_corrupt_record")


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """Normalized documents, a JSON line each, with a doc_id."""
    return spark.read.schema("doc_id string, " + NORMALIZED).json(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, byte_size) of all files below a folder, their paths relative to it."""
    top = urlparse(root).path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring(F.col("path"), F.locate(top, F.col("path")) + len(top), F.length("path"))
    return files.select(path.alias("path"), "content", F.col("length").alias("byte_size"))


def _any_case(ending: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)


def read_files(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """Files below a path: doc_id, file_name, mime_type, source_type, content. Only files of ``kinds``, if given, are opened.

    Names of no known ending are of the type ``unknown``: for these, content
    is null and ``byte_size`` tells their length, so that nothing of them is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    wanted = [e for endings, kind in EXTENSIONS for e in endings if kind in kinds]
    if wanted:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(map(_any_case, wanted)) + "}")
    name = F.element_at(F.split("path", "/"), -1)
    kind = source_type(name, F.lit(None).cast("string"))
    content = F.lit(None).cast("binary") if kinds == ("unknown",) else F.col("content")
    files = reader.load(path).select(
        F.sha2("path", 256).alias("doc_id"), name.alias("file_name"), F.lit(None).cast("string").alias("mime_type"), kind.alias("source_type"), content.alias("content"), F.col("length").alias("byte_size")
    )
    return files.where(F.col("source_type").isin(*kinds)) if kinds else files
