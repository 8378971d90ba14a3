"""DOCX: only unzipping runs in Python, paragraphs are column expressions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.shared import settle
from docweft.functions.text import xml_entities
from docweft.operators.assemble import documents, pages_from_texts

ENTRY = "word/document.xml"


def paragraph_count(xml: Column) -> Column:
    """Ends of paragraphs, empty ones too."""
    return F.size(F.split(xml, "</w:p>", -1)) - 1


def paragraphs(xml: Column) -> Column:
    """Text of every paragraph that has a text run, entities decoded."""
    breaks = F.regexp_replace(F.replace(xml, F.lit("<w:tab/>"), F.lit("\t")), "<w:(?:br|cr)/>", "\n")
    pieces = F.transform(F.split(breaks, "</w:p>", -1), lambda p: F.regexp_extract_all(p, F.lit(r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t>"), F.lit(1)))
    return F.transform(F.filter(pieces, lambda t: F.size(t) > 0), lambda t: xml_entities(F.array_join(t, "")))


def _xml_of(content: bytes) -> tuple[str | None, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(ENTRY).decode("utf-8"), None
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError, TypeError) as e:
        return None, f"docx: {type(e).__name__}"


def unzip(files: DataFrame) -> DataFrame:
    """``files`` (doc_id, file_name, mime_type, content) with xml and error instead of content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [_xml_of(c) for c in rows["content"]]
            yield rows[["doc_id", "file_name", "mime_type"]].assign(xml=[x for x, _ in found], error=[e for _, e in found])

    columns = files.select("doc_id", "file_name", "mime_type", "content")
    return columns.mapInPandas(run, "doc_id string, file_name string, mime_type string, xml string, error string")


def read_docx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, one page with a block for each paragraph, and (doc_id, error) of files that can't be read."""
    rows = settle(unzip(files))  # unzipped once, for documents and errors
    pages = pages_from_texts(F.col("doc_id"), F.array(paragraphs(F.col("xml"))), "synthetic")
    extra = {"parser_provider": F.lit("docx-parser"), "docx_provider": F.lit("zip-docx"), "paragraph_count": paragraph_count(F.col("xml"))}
    docs = documents(rows.where("error is null"), F.col("doc_id"), F.lit("docx"), pages, F.col("file_name"), F.col("mime_type"), extra)
    return docs, rows.where("error is not null").select("doc_id", "error")
