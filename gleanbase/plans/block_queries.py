"""Queries over blocks, channels and the block table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions import values as v
from ..operators import blocks as B
from ..operators import sketches
from ..operators import filters, reports
from ..operators.rows import last_per_key
from ..session import scratch_path, written
from ..sources import channels as C
from ..sources.files import read_blocks_csv
from ..sources.tables import block_table, vector_table
from ..streaming.ingest import landed_records, start_ingest, start_upsert
from ..streaming.latest import newer_only
from .catalog import (ARCHIVE, CHANNELS, IS_PDF, LINKED, archive, channel_rows, heavy, linked, query, site_sql,
                      strip_html_sql, table)
from .ingest import Counts, ingest_channels, sync_channels
from .text_queries import WIKI_PAGE_TEXTS, wiki_pages

SINCE, TILL = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 20, 12)
WINDOW_SQL = "created_at > TIMESTAMP '2024-01-03 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'"
AS_OF = dt.datetime(2024, 6, 1)


def _ntz_value(moment: dt.datetime):
    # a literal without zone, so that the bound compares with the scanned type and is pushed down
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- urls, filters, routing -----------------------------------------------------------

@query("url_host", f"SELECT page_id, {site_sql('url')} AS site FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", urls.site(F.col("url")).alias("site"))


@query("host_allow", f"""
WITH sites AS (SELECT page_id, url, {site_sql('url')} AS site FROM pages)
SELECT page_id, url FROM sites
WHERE site IN (SELECT site FROM sites GROUP BY site HAVING count(*) >= 3)""")
def host_allow(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    allowed = pages.groupBy(urls.site(F.col("url")).alias("site")).count().filter("count >= 3").select("site")
    return filters.site_allowed(pages, allowed, "url", "page_id")


@query("has_source", f"""
WITH {ARCHIVE}, b AS (
  SELECT id, source_url IS NOT NULL AS src,
         CASE WHEN source_url LIKE '%#top' THEN '' ELSE source_url END AS url FROM archive)
SELECT id, 'stored' AS use FROM b WHERE src UNION ALL
SELECT id, 'parsed' AS use FROM b WHERE src AND coalesce(url, '') <> ''""")
def has_source(spark, d):
    url = F.when(F.col("source_url").endswith("#top"), "").otherwise(F.col("source_url"))
    blocks = archive(spark, d).select(
        "id", F.when(F.col("source_url").isNotNull(), F.struct(url.alias("url"))).alias("source"))
    return filters.has_source(blocks).select("id", F.lit("stored").alias("use")).unionByName(
        filters.has_source_url(blocks).select("id", F.lit("parsed").alias("use")))


@query("content_route", f"""
WITH {LINKED}
SELECT page_id, url,
       CASE WHEN {IS_PDF} THEN 'pdf' WHEN contains(url, 'wikipedia.org') THEN 'wiki' ELSE 'html' END AS route,
       CASE WHEN {IS_PDF} THEN 'pdf' ELSE 'skip' END AS route_pdf_only
FROM linked""")
def content_route(spark, d):
    at = F.col("url"), F.col("content_type")
    return linked(spark, d).select("page_id", "url", filters.route(*at).alias("route"),
                                   filters.route(*at, pdf_only=True).alias("route_pdf_only"))


@query("job_mode", f"""
WITH {LINKED}
SELECT page_id, 'all' AS mode FROM linked UNION ALL
SELECT page_id, 'pdf_only' FROM linked WHERE {IS_PDF} UNION ALL
SELECT page_id, 'wikipedia_only' FROM linked WHERE url LIKE 'https://en.wikipedia.org/%'
   OR url = 'https://en.wikipedia.org'""")
def job_mode(spark, d):
    blocks = linked(spark, d).select(
        "page_id", F.col("page_id").cast("string").alias("id"), F.struct("url", "content_type").alias("source"))
    out = None
    for mode in filters.MODES:
        part = filters.by_mode(blocks, mode).select("page_id", F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out


@query("date_window", f"WITH {CHANNELS} SELECT event_id, id, created_at FROM channel_rows WHERE {WINDOW_SQL}")
def date_window(spark, d):
    return filters.date_window(channel_rows(spark, d), _ntz_value(SINCE), _ntz_value(TILL)).select(
        "event_id", "id", "created_at")


@query("channel_allow", f"""
WITH {CHANNELS} SELECT event_id, id, channel FROM channel_rows WHERE channel IN ('click', 'signup', 'view')""")
def channel_allow(spark, d):
    return filters.channels_allowed(channel_rows(spark, d), ["view", "click", "signup"]).select(
        "event_id", "id", "channel")


# --- channels -------------------------------------------------------------------------

def _pages(spark, d):
    """Events packed into landed pages: at most 100 blocks each, by arrival."""
    rows = channel_rows(spark, d).withColumn("page", F.expr("event_id div 100 + 1"))
    block = F.struct(
        "id", F.concat("channel", F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("channel") != "signup", F.concat(F.lit("text of "), F.col("event_id").cast("string"))).alias("content"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "metadata",
        F.struct(F.concat(F.lit("https://en.wikipedia.org/"), "id").alias("url"),
                 F.lit("text/html").alias("content_type")).alias("source"),
        F.lit(None).cast("struct<square:struct<url:string>,large:struct<url:string>>").alias("image"))
    packed = rows.groupBy("channel", "page").agg(
        F.array_sort(F.collect_list(F.struct("event_id", block.alias("block")))).alias("items"))
    return packed.select("channel", "page", F.col("items.block").alias("contents"))


@query("flatten_channels", f"""
WITH {CHANNELS}
SELECT upper(channel) AS title, event_id // 100 + 1 AS page, id,
       CAST(row_number() OVER (PARTITION BY channel, event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS pos,
       channel || ' ' || event_id AS block_title
FROM channel_rows""")
def flatten_channels(spark, d):
    pages = _pages(spark, d)
    headers = table(spark, d, "events").select(F.col("event_type").alias("slug")).distinct().select(
        "slug", F.upper("slug").alias("channel_title"), F.array().alias("contents"))
    titled = C.with_headers(pages, headers)
    flat = titled.select("channel", "page", "channel_title", F.posexplode("contents").alias("pos", "block"))
    return flat.select(F.col("channel_title").alias("title"), "page", "block.id", "pos",
                       F.col("block.title").alias("block_title"))


@query("land_channels", f"""
WITH {CHANNELS}
SELECT channel, event_id // 100 + 1 AS page, id, channel || ' ' || event_id AS title,
       CAST(json_extract(metadata, '$.k') AS INTEGER) AS k
FROM channel_rows""")
def land_channels(spark, d):
    path = scratch_path(spark, "landing")
    _pages(spark, d).write.json(path)
    return C.flatten(C.read_pages(spark, path)).select(
        "channel", "page", "id", "title", v.json_field(F.col("metadata"), "$.k", "int").alias("k"))


# Blocks counted off in arrival order, 2,550 to a channel and 100 to a page; blocks of
# extreme value were taken down, which leaves short pages in the middle. They stay in the
# result, marked, where their page does.
@query("complete_pages", """
WITH placed AS (
  SELECT event_id, 'c' || (event_id // 2550) AS channel,
         (event_id - (event_id // 2550) * 2550) // 100 + 1 AS page, NOT coalesce(value <= 300, false) AS gone
  FROM events),
sizes AS (SELECT channel, page, count(*) AS n FROM placed WHERE NOT gone GROUP BY ALL),
broken AS (
  SELECT channel, page, n,
         lag(page, 1, 0) OVER (PARTITION BY channel ORDER BY page) <> page - 1 AS gap
  FROM sizes),
ends AS (
  SELECT channel, min(CASE WHEN gap THEN page - 1 WHEN n <> 100 THEN page END) AS last_page,
         max(page) AS top FROM broken GROUP BY channel)
SELECT p.event_id, p.channel, p.page, CAST(p.gone AS INTEGER) AS gone
FROM placed p JOIN ends e ON p.channel = e.channel AND p.page <= coalesce(e.last_page, e.top)""")
def complete_pages(spark, d):
    placed = table(spark, d, "events").selectExpr(
        "event_id", "concat('c', event_id div 2550) as channel",
        "(event_id - (event_id div 2550) * 2550) div 100 + 1 as page", "not coalesce(value <= 300, false) as gone")
    sizes = placed.filter("not gone").groupBy("channel", "page").agg(F.count("*").alias("n"))
    return C.complete_prefix(placed, C.last_pages(sizes), "event_id").select(
        "event_id", "channel", "page", F.col("gone").cast("int").alias("gone"))


@query("last_per_id", """
SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS event_id,
       arg_max(event_type, event_id) AS channel, arg_max(props, event_id) AS metadata
FROM events GROUP BY user_id""")
def last_per_id(spark, d):
    return last_per_key(channel_rows(spark, d), ["id"], ["event_id"]).select("id", "event_id", "channel", "metadata")


@query("block_channels", f"""
WITH {CHANNELS}
SELECT id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels
FROM channel_rows WHERE {WINDOW_SQL} GROUP BY id""")
def block_channels(spark, d):
    rows = filters.date_window(channel_rows(spark, d), _ntz_value(SINCE), _ntz_value(TILL))
    return C.channels_per_block(rows).select("id", F.concat_ws(",", "channels").alias("channels"))


@query("channel_names", f"WITH {CHANNELS} SELECT DISTINCT channel FROM channel_rows WHERE {WINDOW_SQL}")
def channel_names(spark, d):
    return C.channel_names(filters.date_window(channel_rows(spark, d), _ntz_value(SINCE), _ntz_value(TILL)))


@query("union_channels", f"""
WITH {CHANNELS}, ordered AS (
  SELECT *, list_position(['view', 'click', 'signup', 'error', 'purchase'], channel) - 1 AS channel_ord
  FROM channel_rows)
SELECT id, CAST(channel_ord AS INTEGER) AS channel_ord, event_id, rows_before FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY channel_ord DESC, event_id DESC) AS n,
         count(*) OVER (PARTITION BY id) AS rows_before FROM ordered) WHERE n = 1""")
def union_channels(spark, d):
    both = C.in_order(channel_rows(spark, d), ["view", "click", "signup", "error", "purchase"])
    return both.groupBy("id").agg(
        F.max(F.struct("channel_ord", "event_id")).alias("last"), F.count("*").alias("rows_before")).select(
        "id", "last.channel_ord", "last.event_id", "rows_before")


@query("distinct_urls", f"""
WITH {ARCHIVE}, all_urls AS (
  SELECT source_url FROM archive WHERE coalesce(source_url, '') <> '' UNION ALL SELECT url FROM pages)
SELECT source_url, count(*) AS blocks FROM all_urls GROUP BY source_url""")
def distinct_urls(spark, d):
    seen = filters.has_source_url(archive(spark, d).select("source_url"), "source_url").unionByName(
        table(spark, d, "pages").select(F.col("url").alias("source_url")))
    return seen.groupBy("source_url").agg(F.count("*").alias("blocks"))


# --- block table ----------------------------------------------------------------------

@query("block_rows", f"""
WITH {ARCHIVE}
SELECT a.id, a.source_url, {strip_html_sql('p.html')} AS crawled_text, a.title, a.description,
       CASE WHEN a.description IS NULL THEN NULL ELSE '{{"lang":"' || a.description || '"}}' END AS metadata,
       a.id AS json_id, a.source_url AS json_url
FROM archive a JOIN pages p ON p.url = a.source_url""")
def block_rows(spark, d):
    raw = archive(spark, d).select(
        "id", "title", "description", F.lit(None).cast("string").alias("content"),
        F.when(F.col("description").isNull(), "{ }").otherwise(
            F.concat(F.lit('{"lang":"'), "description", F.lit('"}'))).alias("metadata"),
        F.when(F.col("source_url").isNotNull(), F.struct(F.col("source_url").alias("url"))).alias("source"))
    content = heavy(spark, d, "pages", "url", "html").select(
        F.col("url").alias("source_url"), tx.strip_html(F.col("html")).alias("content"))
    rows = B.block_rows(raw, content)
    return rows.select("id", "source_url", "crawled_text", "title", "description", "metadata",
                       F.get_json_object("full_json", "$.id").alias("json_id"),
                       F.get_json_object("full_json", "$.source.url").alias("json_url"))


@query("unparsed_blocks", """
SELECT CAST(page_id AS VARCHAR) AS id, url FROM pages
WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')""")
def unparsed_blocks(spark, d):
    stored = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("lang") != "de", F.col("text")).alias("crawled_text"))
    batch = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url")
    return filters.needs_parsing(batch, stored)


@query("lookup_ids", f"""
WITH {ARCHIVE} SELECT id, source_url, title, description, crawled_text
FROM archive WHERE id IN (SELECT CAST(user_id AS VARCHAR) FROM events)""")
def lookup_ids(spark, d):
    ids = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"))
    return filters.lookup(archive(spark, d), ids).select(
        "id", "source_url", "title", "description", "crawled_text")


@query("attach_content", f"""
WITH {ARCHIVE}
SELECT a.id, a.source_url, {strip_html_sql('p.html')} AS content
FROM archive a LEFT JOIN pages p ON p.url = a.source_url""")
def attach_content(spark, d):
    content = heavy(spark, d, "pages", "url", "html").select(
        F.col("url").alias("source_url"), tx.strip_html(F.col("html")).alias("content"))
    return B.attach_content(archive(spark, d).select("id", "source_url"), content).select("id", "source_url", "content")


def _stored(spark, d):
    """All documents; German ones have no text yet."""
    at = F.lit(dt.datetime(2024, 1, 1))
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("lang") != "de", F.col("text")).alias("crawled_text"), F.col("source").alias("title"),
        F.col("lang").alias("description"), F.lit(None).cast("string").alias("metadata"),
        at.alias("created_at"), at.alias("updated_at"), F.lit("{}").alias("full_json"))


def _batch(spark, d):
    """All pages. Those under a #top address came without text, .html pages are new blocks."""
    return table(spark, d, "pages").select(
        F.concat(F.when(F.col("url").endswith(".html"), "p").otherwise(""), F.col("page_id").cast("string")).alias("id"),
        F.col("url").alias("source_url"), F.lit('{"page":1}').alias("full_json"),
        F.when(~F.col("url").endswith("#top"), F.md5("html")).alias("crawled_text"),
        urls.authority(F.col("url")).alias("title"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("metadata"))


def _upsert_sql(text: str) -> str:
    return f"""
WITH stored AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang <> 'de' THEN text END AS crawled_text, source AS title,
         lang AS description FROM documents),
batch AS (
  SELECT CASE WHEN url LIKE '%.html' THEN 'p' ELSE '' END || page_id AS id, url AS source_url,
         CASE WHEN url NOT LIKE '%#top' THEN md5(html) END AS crawled_text,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2) AS title FROM pages)
SELECT coalesce(s.id, b.id) AS id, b.source_url,
       CASE WHEN b.id IS NULL THEN s.crawled_text ELSE {text} END AS crawled_text,
       CASE WHEN b.id IS NULL THEN s.title ELSE b.title END AS title,
       CASE WHEN b.id IS NULL THEN s.description END AS description,
       CASE WHEN s.id IS NULL THEN '2024-06-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS created_at,
       CASE WHEN b.id IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-06-01 00:00:00' END AS updated_at
FROM stored s FULL OUTER JOIN batch b ON s.id = b.id"""


def _shown(blocks):
    return blocks.select("id", "source_url", "crawled_text", "title", "description",
                         _time("created_at"), _time("updated_at"))


@query("upsert_overwrite", _upsert_sql("b.crawled_text"))
def upsert_overwrite(spark, d):
    return _shown(B.merge_blocks(_stored(spark, d), _batch(spark, d), AS_OF, "overwrite"))


@query("upsert_keep_text", _upsert_sql("coalesce(b.crawled_text, s.crawled_text)"))
def upsert_keep_text(spark, d):
    return _shown(B.merge_blocks(_stored(spark, d), _batch(spark, d), AS_OF))


@query("upsert_table", _upsert_sql("coalesce(b.crawled_text, s.crawled_text)"))
def upsert_table(spark, d):
    blocks = block_table(spark, scratch_path(spark, "blocks"), buckets=8)
    blocks.upsert(_stored(spark, d), B.replace_parts)
    for _ in range(2):  # a batch that comes again changes nothing
        blocks.upsert(_batch(spark, d), lambda old, new: B.merge_parts(old, new, AS_OF))
    return _shown(blocks.read())


@query("upsert_newer", """
WITH s AS (SELECT user_id AS id, max(ts) AS at, arg_max(props, ts) AS metadata
           FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id),
b AS (SELECT user_id AS id, max(ts) AS at, arg_max(props, ts) AS metadata
      FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id)
SELECT CAST(coalesce(s.id, b.id) AS VARCHAR) AS id,
       CASE WHEN s.id IS NULL OR b.at > s.at THEN b.metadata ELSE s.metadata END AS metadata,
       strftime(coalesce(s.at, b.at), '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(CASE WHEN s.id IS NULL OR b.at > s.at THEN b.at ELSE s.at END, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM s FULL OUTER JOIN b ON s.id = b.id""")
def upsert_newer(spark, d):
    def side(kinds):
        rows = filters.channels_allowed(channel_rows(spark, d), kinds)
        last = last_per_key(rows, ["id"], ["created_at", "event_id"])
        none = F.lit(None).cast("string")
        return last.select("id", none.alias("source_url"), none.alias("full_json"), none.alias("crawled_text"),
                           none.alias("title"), none.alias("description"), "metadata",
                           F.col("created_at").cast("timestamp").alias("updated_at"))
    stored = side(["view", "click", "error"]).withColumn("created_at", F.col("updated_at"))
    merged = B.merge_blocks(stored, side(["purchase", "signup"]), F.current_timestamp(), "newer")
    return merged.select("id", "metadata", _time("created_at"), _time("updated_at"))


@query("metadata_json", """
WITH m AS (SELECT event_id, CASE WHEN event_type = 'error' THEN left(props, 4) ELSE props END AS metadata FROM events)
SELECT event_id, CAST(CASE WHEN json_valid(metadata) THEN json_extract(metadata, '$.k') END AS INTEGER) AS k,
       CASE WHEN json_valid(metadata) THEN 0 ELSE 1 END AS bad, CAST(event_id AS VARCHAR) AS packed_id,
       metadata AS packed_metadata
FROM m""")
def metadata_json(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.left("props", F.lit(4))).otherwise(
            F.col("props")).alias("metadata"))
    packed = v.json_text(F.struct("event_id", "metadata"))
    return rows.select(
        "event_id", v.json_field(F.col("metadata"), "$.k", "int").alias("k"),
        v.is_bad_json(F.col("metadata")).cast("int").alias("bad"),
        v.json_field(packed, "$.event_id").alias("packed_id"),
        v.json_field(packed, "$.metadata").alias("packed_metadata"))


def _submissions(spark, d):
    """Events as records handed in: by address, or by file for signups and purchases."""
    events = table(spark, d, "events")
    pages = table(spark, d, "pages").select("page_id", "url")
    file_name = F.when(F.col("event_type") == "signup", F.concat(F.lit("note "), F.col("user_id").cast("string"), F.lit(".PDF"))) \
        .when(F.col("event_type") == "purchase", F.concat(F.lit("bill "), F.col("user_id").cast("string"), F.lit(".txt")))
    return events.join(pages, events.user_id == pages.page_id, "left").select(
        "url", file_name.alias("file_name"), F.col("event_id").cast("string").alias("title"),
        F.lit(None).cast("string").alias("description"), F.col("props").alias("metadata"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("text of "), F.col("event_id").cast("string"))).alias("content"),
        F.col("ts").cast("timestamp").alias("submitted_at"))


_SUBMITTED = """
WITH r AS (
  SELECT url, CASE event_type WHEN 'signup' THEN 'note ' || user_id || '.PDF'
                              WHEN 'purchase' THEN 'bill ' || user_id || '.txt' END AS file_name,
         CAST(event_id AS VARCHAR) AS title, props AS metadata, ts,
         CASE WHEN event_type <> 'error' THEN 'text of ' || event_id END AS content
  FROM events LEFT JOIN pages ON user_id = page_id),
j AS (SELECT *, CASE WHEN coalesce(file_name, url) IS NULL THEN 'no address'
                     WHEN lower(file_name) NOT LIKE '%.pdf' THEN 'not a pdf file'
                     WHEN content IS NULL THEN 'no content' END AS reason FROM r)"""


@query("record_ids", _SUBMITTED + """
SELECT CASE WHEN file_name IS NULL THEN 'manual_' ELSE 'file_' END || strftime(ts, '%Y%m%d_%H%M%S') || '_'
         || left(sha256(coalesce(file_name, url)), 8) AS id,
       coalesce(file_name, url) AS url, title, content,
       CAST(json_extract(metadata, '$.k') AS INTEGER) AS k
FROM j WHERE reason IS NULL""")
def record_ids(spark, d):
    good, _ = B.submitted_blocks(_submissions(spark, d))
    return good.select("id", "source.url", "title", "content",
                       v.json_field(F.col("metadata"), "$.k", "int").alias("k"))


@query("record_rejects", _SUBMITTED + " SELECT title, reason FROM j WHERE reason IS NOT NULL")
def record_rejects(spark, d):
    return B.submitted_blocks(_submissions(spark, d))[1].select("title", "reason")


@query("csv_blocks", """
SELECT CAST(doc_id AS VARCHAR) AS block_id, source AS title, text AS description, 'https://a.example/' || doc_id AS source_url
FROM documents""")
def csv_blocks(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("block_id"), F.col("source").alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string")).alias("source_url"),
    ).write.option("header", True).option("escape", '"').option("quoteAll", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_blocks_csv(spark, path)


# --- jobs -----------------------------------------------------------------------------

@query("ingest_job", """
WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS channel, max(event_id) AS event_id
           FROM events GROUP BY user_id),
""" + f"""{WIKI_PAGE_TEXTS}
SELECT CAST(user_id AS VARCHAR) AS id, 'v' || event_id AS title, source_url, content AS crawled_text
FROM e JOIN wiki_texts ON doc_id = user_id""")
def ingest_job(spark, d):
    blocks = block_table(spark, scratch_path(spark, "blocks"), buckets=8)
    ingest_channels([_event_blocks(spark, d)], wiki_pages(spark, d), blocks, None, AS_OF)
    return blocks.read().select("id", "title", "source_url", "crawled_text")


# The figures of the same run, taken by its own jobs.
@query("ingest_counts", f"""
WITH {WIKI_PAGE_TEXTS},
e AS (SELECT DISTINCT user_id FROM events), b AS (SELECT user_id, source_url, content FROM e LEFT JOIN wiki_texts ON doc_id = user_id)
SELECT count(*) AS blocks, count(source_url) AS with_url, count(DISTINCT source_url) AS parsed,
       count(DISTINCT CASE WHEN content = '' THEN source_url END) AS failed, count(*) FILTER (content <> '') AS with_text FROM b""")
def ingest_counts(spark, d):
    counts = Counts()
    ingest_channels([_event_blocks(spark, d)], wiki_pages(spark, d), block_table(spark, scratch_path(spark, "blocks"), buckets=8),
                    None, AS_OF, counts=counts)
    figures = counts.get()
    return spark.createDataFrame([tuple(figures.values())], ", ".join(f"{n} long" for n in figures))


def _event_blocks(spark, d):
    pages = wiki_pages(spark, d)
    return channel_rows(spark, d).join(
        pages.select(F.col("page_id").cast("string").alias("id"), "url"), "id", "left").select(
        "id", "channel", F.lit(1).cast("long").alias("page"), F.col("event_id").alias("pos"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("description"), F.col("metadata"),
        F.when(F.col("url").isNotNull(), F.struct("url", F.lit("text/html").alias("content_type"))).alias("source"))


@query("sync_job", f"""
WITH {CHANNELS}, kept AS (
  SELECT *, CASE channel WHEN 'view' THEN 0 ELSE 1 END AS o FROM channel_rows
  WHERE channel IN ('view', 'signup') AND date_trunc('second', created_at) > TIMESTAMP '2024-01-03 00:00:00'
    AND date_trunc('second', created_at) <= TIMESTAMP '2024-01-20 12:00:00'),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC, event_id DESC) AS n FROM kept)
SELECT id, channel || ' ' || event_id AS title, 'https://en.wikipedia.org/' || id AS source_url,
       CASE WHEN channel <> 'signup' THEN 'text of ' || event_id END AS crawled_text,
       '' AS metadata, '2024-06-01 00:00:00' AS updated_at FROM last WHERE n = 1""")
def sync_job(spark, d):
    rows = C.in_order(C.flatten(_pages(spark, d)), ["view", "signup", "error", "click", "purchase"])
    blocks = block_table(spark, scratch_path(spark, "blocks"), buckets=8)
    sync_channels(rows, blocks, AS_OF, SINCE, TILL, ["view", "signup"])
    return blocks.read().select("id", "title", "source_url", "crawled_text", "metadata", _time("updated_at"))


@query("stream_ingest", """
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS title, arg_max(props, event_id) AS metadata,
       strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM events GROUP BY user_id""")
def stream_ingest(spark, d):
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    blocks = block_table(spark, scratch_path(spark, "blocks"), buckets=8)

    def prepare(batch):
        last = last_per_key(batch, ["user_id"], ["event_id"])
        none = F.lit(None).cast("string")
        return last.select(F.col("user_id").cast("string").alias("id"), none.alias("source_url"),
                           none.alias("full_json"), none.alias("crawled_text"), F.col("event_type").alias("title"),
                           none.alias("description"), F.col("props").alias("metadata"), "ts")

    start_upsert(rows, blocks, prepare, lambda old, new: B.merge_parts(old, new, F.col("ts")),
                 scratch_path(spark, "offsets")).awaitTermination()
    return blocks.read().select("id", "title", "metadata", _time("updated_at"))


# The events land in three files that hold earlier and later ones alike, and the first of them
# lands again at last: what a block has in the end is its last event by time, then number.
@query("stream_latest", """
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, (ts, event_id)) AS title, arg_max(props, (ts, event_id)) AS metadata,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM events GROUP BY user_id""")
def stream_latest(spark, d):
    landing, offsets = scratch_path(spark, "landing"), scratch_path(spark, "offsets")
    events = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    blocks = block_table(spark, scratch_path(spark, "blocks"), buckets=8)

    def prepare(batch):
        none = F.lit(None).cast("string")
        return batch.select(F.col("user_id").cast("string").alias("id"), none.alias("source_url"), none.alias("full_json"),
                            none.alias("crawled_text"), F.col("event_type").alias("title"), none.alias("description"),
                            F.col("props").alias("metadata"), "ts")

    for part in (0, 1, 2, 0):  # each time the stream is started again from its checkpoint
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(landing)
        rows = newer_only(landed_records(spark, landing, events.schema, "parquet"), "user_id", ["at", "event_id"])
        start_upsert(rows, blocks, prepare, lambda old, new: B.merge_parts(old, new, F.col("ts")), offsets).awaitTermination()
    return blocks.read().select("id", "title", "metadata", _time("updated_at"))


# Submitted records land as files, go through the stream to both tables, and all of them
# come a second time under a new checkpoint, which must change nothing.
@query("stream_records", _SUBMITTED + """, good AS (
  SELECT CASE WHEN file_name IS NULL THEN 'manual_' ELSE 'file_' END || strftime(ts, '%Y%m%d_%H%M%S') || '_'
         || left(sha256(coalesce(file_name, url)), 8) AS id, title, content, ts FROM j WHERE reason IS NULL),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, title DESC, content DESC) AS n FROM good)
SELECT 'block' AS kind, id, title, content AS text FROM last WHERE n = 1 UNION ALL
SELECT 'point', id, title, left(content, 200) FROM last WHERE n = 1 UNION ALL
SELECT 'reject', NULL, title, reason FROM j WHERE reason IS NOT NULL""")
def stream_records(spark, d):
    landing, rejects = scratch_path(spark, "landing"), scratch_path(spark, "rejects")
    _submissions(spark, d).write.parquet(landing)
    blocks, vectors = block_table(spark, scratch_path(spark, "blocks"), buckets=8), vector_table(
        spark, scratch_path(spark, "vectors"), buckets=8)
    for _ in range(2):
        start_ingest(landed_records(spark, landing, fmt="parquet"), blocks, vectors, scratch_path(spark, "offsets"),
                     rejects).awaitTermination()
    turned_down = spark.read.schema("batch int, title string, reason string").json(rejects)
    return blocks.read().select(F.lit("block").alias("kind"), "id", "title", F.col("crawled_text").alias("text")).union(
        vectors.read().select(F.lit("point"), "id", "payload.title", "payload.text_preview")).union(
        turned_down.select(F.lit("reject"), F.lit(None).cast("string"), "title", "reason"))


# The limit of a search request: a leading number of a text, else ten.
@query("request_limits", r"""
WITH r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN props WHEN event_type <> 'view'
             THEN ' ' || json_extract_string(props, '$.k') || ' hits' END AS asked FROM events)
SELECT event_id, coalesce(TRY_CAST(regexp_extract(asked, '^\s*([+-]?\d+)', 1) AS INTEGER), 10) AS k FROM r""")
def request_limits(spark, d):
    number = F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" hits"))
    asked = F.when(F.col("event_type") == "error", F.col("props")).when(F.col("event_type") != "view", number)
    return table(spark, d, "events").select("event_id", v.int_or(asked, 10).alias("k"))


# --- reports --------------------------------------------------------------------------

@query("stage_counts", f"""
WITH {ARCHIVE}, b AS (SELECT id, source_url, CASE WHEN description = 'de' THEN NULL ELSE crawled_text END AS crawled_text
                      FROM archive)
SELECT count(*) AS blocks, count(*) FILTER (source_url <> '') AS with_url,
       count(*) FILTER (source_url <> '' AND crawled_text IS NULL) AS to_parse,
       count(DISTINCT CASE WHEN source_url <> '' AND crawled_text IS NULL THEN source_url END) AS urls_to_parse,
       count(*) FILTER (crawled_text <> '') AS points
FROM b""")
def stage_counts(spark, d):
    return reports.stage_counts(_some_text(spark, d))


def _some_text(spark, d):
    return archive(spark, d).withColumn("crawled_text", F.when(
        F.coalesce(F.col("description"), F.lit("")) != "de", F.col("crawled_text")))


@query("quality_report", f"""
WITH {ARCHIVE}, b AS (SELECT source_url, CASE WHEN description = 'de' THEN NULL ELSE crawled_text END AS crawled_text
                      FROM archive)
SELECT {site_sql("coalesce(source_url, '')")} AS site, count(*) AS blocks,
       count(*) FILTER (crawled_text IS NULL) AS without_text, count(*) FILTER (crawled_text = '') AS empty_text,
       round(avg(length(crawled_text)), 2) AS mean_length
FROM b GROUP BY 1""")
def quality_report(spark, d):
    return reports.quality_by_site(_some_text(spark, d))


@query("missing_ids", """
SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE page_id NOT IN (SELECT user_id FROM events)""")
def missing_ids(spark, d):
    before = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"))
    return reports.missing_since(before, channel_rows(spark, d))


# The figures of each day's sync are stored as sketches and put together for the whole span.
@query("span_report", """
WITH n AS (SELECT event_type AS channel, count(*) AS rows FROM events GROUP BY ALL)
SELECT channel, rows, true AS ids_close, true AS median_close, true AS same_as_whole FROM n""")
def span_report(spark, d):
    rows = channel_rows(spark, d).select("id", "channel", F.length("metadata").alias("size"), F.to_date("created_at").alias("sync"))
    stored = written(sketches.sketch(rows, ["sync", "channel"], "id", "size"), "sketches")
    span = sketches.report(sketches.merge(stored, ["channel"]), [0.5])
    whole = sketches.report(sketches.sketch(rows, ["channel"], "id", "size"), [0.5])
    true = rows.groupBy("channel").agg(F.count_distinct("id").alias("ids"), F.median("size").alias("median"))
    both = span.join(whole.select("channel", F.col("distinct_ids").alias("whole_ids")), "channel").join(true, "channel")
    close = F.abs(F.col("distinct_ids") - F.col("ids")) <= sketches.ID_ERROR * F.col("ids")
    return both.select("channel", "rows", close.alias("ids_close"), (F.abs(F.col("sizes")[0] - F.col("median")) <= 1).alias("median_close"),
                       (F.abs(F.col("distinct_ids") - F.col("whole_ids")) <= sketches.ID_ERROR * F.col("ids")).alias("same_as_whole"))
