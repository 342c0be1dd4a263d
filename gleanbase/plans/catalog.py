"""Registry of the example queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import fill_cores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def heavy(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table about to go through work that is heavy per row."""
    return fill_cores(table(spark, folder, name).select(*columns))


# How the given tables play the archive: documents are stored blocks, pages the landed
# pages of the same number, events the contents of channels, embeddings vector points.

def archive(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    pages = table(spark, folder, "pages").select("page_id", F.col("url").alias("source_url"))
    return docs.join(pages, docs.doc_id == pages.page_id, "left").select(
        F.col("doc_id").cast("string").alias("id"), "source_url", F.col("text").alias("crawled_text"),
        F.col("source").alias("title"), F.nullif(F.col("lang"), F.lit("en")).alias("description"))


ARCHIVE = """
archive AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, p.url AS source_url, d.text AS crawled_text,
         d.source AS title, nullif(d.lang, 'en') AS description
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def linked(spark: SparkSession, folder: str) -> DataFrame:
    """Pages under addresses of all routes."""
    url = F.regexp_replace("url", r"\.html$", ".pdf")
    url = F.regexp_replace(url, r"^(https?)://[^/]*\.example\.org", "$1://en.wikipedia.org")
    kind = (
        F.when(F.col("url").contains("/fr/"), "Application/PDF;v=1")
        .when(F.col("url").contains("/es/"), None).otherwise("text/html"))
    return table(spark, folder, "pages").select("page_id", url.alias("url"), "html", kind.alias("content_type"))


LINKED = r"""
linked AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(url, '\.html$', '.pdf'),
                        '^(https?)://[^/]*\.example\.org', '\1://en.wikipedia.org') AS url,
         CASE WHEN url LIKE '%/fr/%' THEN 'Application/PDF;v=1'
              WHEN url LIKE '%/es/%' THEN NULL ELSE 'text/html' END AS content_type
  FROM pages)"""

IS_PDF = "(lower(url) LIKE '%.pdf' OR coalesce(lower(content_type) LIKE '%application/pdf%', false))"


def site_sql(url: str) -> str:
    pattern = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)'"
    return (f"lower(regexp_extract({url}, {pattern}, 1)) || '://' || "
            f"regexp_extract({url}, {pattern}, 2) || '/'")


def strip_html_sql(html: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(" + html +
        r", '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
        r", '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'), ' ')")


def channel_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the blocks of five channels, in arrival order."""
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("channel"),
        F.col("ts").alias("created_at"), F.col("props").alias("metadata"), "value")


CHANNELS = """
channel_rows AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS id, event_type AS channel, ts AS created_at,
         props AS metadata, value FROM events)"""
