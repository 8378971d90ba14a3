"""PDF files as documents: text layers, or pages sent to OCR; what can't be read is an error row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions.shared import settle
from docweft.functions.text import nonblank_lines
from docweft.operators.assemble import documents, pages_from_texts
from docweft.sources import ocr
from docweft.sources.pdf_text import page_texts

PAGES = "doc_id string, file_name string, mime_type string, page_texts array<string>, error string, content binary"


def text_layer(files: DataFrame) -> DataFrame:
    """Page texts of PDF files (doc_id, file_name, mime_type, content); error says why there are none.

    Only files without a text layer keep their content, for the OCR that follows in the same tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, errors, kept = [], [], []
            for content in rows["content"]:
                found, error = None, None
                try:
                    found = page_texts(bytes(content))
                except (ValueError, TypeError) as e:
                    error = f"pdf: {e}"
                texts.append(found)
                errors.append(error)
                kept.append(content if error is None and not any(t.strip() for t in found) else None)
            yield rows[["doc_id", "file_name", "mime_type"]].assign(page_texts=texts, error=errors, content=kept)

    return files.select("doc_id", "file_name", "mime_type", "content").mapInPandas(run, PAGES)


def has_text_layer(texts) -> F.Column:
    return F.exists(texts, lambda t: F.size(nonblank_lines(t)) > 0)


def rasterized(rows: DataFrame, rasterizer) -> DataFrame:
    """``rows`` of :func:`text_layer`, a row for each page image of a file that has content.

    ``rasterizer`` gives (page_no, media type, bytes) of each page of a PDF.
    """
    kinds = "doc_id string, file_name string, mime_type string, page_texts array<string>, error string, rasters array<struct<page_no:int,mime_type:string,content:binary>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found, errors = [], []
            for content, error in zip(part["content"], part["error"], strict=True):
                pages = None
                if content is not None:
                    try:
                        pages = [{"page_no": n, "mime_type": m, "content": c} for n, m, c in rasterizer(bytes(content))]
                    except Exception as e:  # an error row, as for every reader
                        error = f"pdf: {e}"
                found.append(pages)
                errors.append(error)
            yield part[["doc_id", "file_name", "mime_type", "page_texts"]].assign(error=errors, rasters=found)

    made = rows.mapInPandas(run, kinds)
    error = F.coalesce("error", ocr.raster_error(F.col("rasters")))
    made = made.withColumn("error", error).withColumn("r", F.explode_outer(F.when(error.isNull(), F.col("rasters"))))
    return made.select("doc_id", "file_name", F.coalesce("r.mime_type", "mime_type").alias("mime_type"), "page_texts", "error", F.col("r.page_no").alias("raster_page_no"), "r.content")


def read_pdf(files: DataFrame, provider: ocr.Provider, name: str, transport: str, rasterizer=None, rasterizer_name: str = "rasterizer") -> tuple[DataFrame, DataFrame]:
    """Documents of PDF files and (doc_id, error). A text layer gives a block for each line; files without one go to
    the OCR provider, page by page where there is a rasterizer, else as they are. Every file is opened and sent once."""
    rows = text_layer(files)
    asked = "page_rasters" if rasterizer else "original_pdf_bytes"
    rows = rasterized(rows, rasterizer) if rasterizer else rows.withColumn("raster_page_no", F.lit(None).cast("int"))
    sent = rows.withColumns(
        {"source_type": F.lit("pdf"), "page_no_hint": F.col("raster_page_no"), "headers": ocr.meta_headers(F.create_map(F.lit("pdf_ocr_input"), F.lit(asked)))}
    )
    rows = settle(ocr.recognize(sent, provider).drop("headers", "source_type", "page_no_hint"))
    failed = rows.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
    good = rows.join(failed.select("doc_id"), "doc_id", "left_anti")
    lines = F.transform("page_texts", nonblank_lines)
    pages = pages_from_texts(F.col("doc_id"), lines, "synthetic")
    common = {"pdf_provider": F.lit("content-stream-text"), "page_count": F.size("page_texts").cast("string"), **({"pdf_raster_provider": F.lit(rasterizer_name)} if rasterizer else {})}
    of_text = {"parser_provider": F.lit("pdf-parser"), **common, "extracted_text_layer": F.lit("true"), "pdf_parse_mode": F.lit("text_layer")}
    docs = documents(good.where("answer is null"), F.col("doc_id"), F.lit("pdf"), pages, F.col("file_name"), F.col("mime_type"), of_text)
    of_scan = {**common, "extracted_text_layer": F.lit("false"), "pdf_parse_mode": F.lit("ocr_fallback"), "pdf_ocr_input": F.lit(asked)}
    parsed = ocr.parse_answers(good.where("answer is not null"))
    if rasterizer:
        parsed = ocr.gather_pages(parsed.withColumn("mime_type", F.lit("application/pdf")), ["doc_id", "file_name", "mime_type", "page_texts"])
    scanned = ocr.documents(parsed, "pdf", name, transport, F.size("page_texts"), of_scan)
    return docs.unionByName(scanned), failed
