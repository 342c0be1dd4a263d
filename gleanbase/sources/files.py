"""Landed pages, the CSV sample form, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import hits


def read_landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html, content_type) as parquet; a table without the
    response type reads it as null."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_blocks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Blocks as CSV with quoted multi-line fields. A file with line breaks inside its
    fields cannot be split, so land large exports as many files."""
    return (
        spark.read.schema(schemas.SAMPLE_CSV)
        .option("header", True).option("multiLine", True).option("escape", '"')
        .csv(path)
    )


def write_hits(found: DataFrame, path: str, form: str = "json") -> None:
    """Search hits as JSON lines or as text blocks."""
    if form == "json":
        found.write.json(path)
    elif form == "text":
        found.select(hit_lines().alias("value")).write.option("lineSep", "\n\n").text(path)
    else:
        raise ValueError("form must be 'json' or 'text'")


def hit_lines():
    return hits.hit_text(F.col("score"), F.col("title"), F.col("source_url"), F.col("text_preview"))
