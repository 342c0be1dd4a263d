"""The page conversion job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import filters, html
from .rows import last_per_key
from .spread import in_parts

PAGES = 64  # pages that a worker holds as Python objects at once


def main_content(pages: DataFrame, key: str = "page_id", cut=html.WIKI_CUT, main: str = html.WIKI_MAIN) -> DataFrame:
    """(key, content): HTML of each page's main element, null without one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, PAGES):
            made = [html.main_content(h or "", cut, main) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, "content"])

    source = pages.select(key, "html")
    return source.mapInArrow(run, T.StructType([source.schema[key], T.StructField("content", T.StringType())]))


def parse_pages(pages: DataFrame, pdf_only: bool = False, arrival: tuple[str, ...] = ("page_id",),
                cut=html.WIKI_CUT, main: str = html.WIKI_MAIN) -> DataFrame:
    """(source_url, route, content, error), one row per distinct address.

    ``pages`` has url, html, content_type and, for documents whose text was extracted
    before landing, pdf_text. Each address is converted once, its latest landing. A page
    that fails or gives no text has null content and an error; pages on the skip route
    give no row. Pages are read and shuffled once, all routes together, and only what a
    route needs of them; the texts of documents pass the conversion as they are.
    """
    if "pdf_text" not in pages.columns:
        pages = pages.withColumn("pdf_text", F.lit(None).cast("string"))
    if "content_type" not in pages.columns:
        pages = pages.withColumn("content_type", F.lit(None).cast("string"))
    usable = filters.has_source_url(pages, "url").withColumn(
        "route", filters.route(F.col("url"), F.col("content_type"), pdf_only)).filter(F.col("route") != "skip").select(
        "url", "route", F.when(F.col("route") == "pdf", F.col("pdf_text")).otherwise(F.col("html")).alias("page"), *arrival)
    once = last_per_key(usable, ["url"], list(arrival))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, PAGES):
            texts, errors = [], []
            for route, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = error = None
                try:
                    text = page if route == "pdf" else (
                        html.wiki_markdown(page or "", cut, main) if route == "wiki" else html.to_markdown(page or ""))
                except Exception as e:  # a page must not stop the job; it is reported
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                ["url", "route", "text", "error"])

    made = once.select("url", "route", "page").mapInArrow(run, "url string, route string, text string, error string")
    cleaned = made.withColumn("content", F.nullif(tx.clean_markdown(F.col("text")), F.lit("")))
    return cleaned.select(
        F.col("url").alias("source_url"), "route", "content",
        F.when(F.col("content").isNull(), F.coalesce("error", F.lit("no content"))).alias("error"),
    )
