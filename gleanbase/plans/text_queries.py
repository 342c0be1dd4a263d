"""Queries over text: cleanup, page conversion, chunks, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import keywords as K
from ..operators.parse import main_content as main_content_job
from ..operators.parse import parse_pages
from ..operators.postings import build_postings, search_words
from ..operators.spread import fill_cores
from ..session import written
from .catalog import ARCHIVE, archive, heavy, linked, query, strip_html_sql, table

# The Unicode blanks of the cleanup, written out for an engine with ASCII classes.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _clean_sql(t: str) -> str:
    return rf"""regexp_replace(replace(replace(regexp_replace(regexp_replace({t},
         '\n{_BLANK}*\n', chr(10) || chr(10), 'g'), '\[\p{{Nd}}+\]', '', 'g'), '[edit]', ''), '[]', ''),
         '^{_BLANK}+|{_BLANK}+$', '', 'g')"""


@query("clean_markdown", rf"""
WITH marked AS (
  SELECT doc_id, '[edit] ' || replace(text, '. ', '.[12] ' || chr(10) || ' ' || chr(160) || chr(10)) || ' [' || lang
         || '] []' || chr(10) || chr(9) AS t FROM documents)
SELECT doc_id, {_clean_sql('t')} AS text FROM marked""")
def clean_markdown(spark, d):
    marked = F.concat(F.lit("[edit] "), F.replace("text", F.lit(". "), F.lit(".[12] \n  \n")),
                      F.lit(" ["), F.col("lang"), F.lit("] []\n\t"))
    return heavy(spark, d, "documents", "doc_id", "text", "lang").select("doc_id", tx.clean_markdown(marked).alias("text"))


@query("html_text", f"SELECT page_id, {strip_html_sql('html')} AS text FROM pages")
def html_text(spark, d):
    return heavy(spark, d, "pages", "page_id", "html").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("html_markdown")
def html_markdown(spark, d):
    return parse_pages(_wikified(linked(spark, d)))


def _wikified(pages):
    """The article of each page as a main element with parts to cut around the title."""
    html = F.replace("html", F.lit("<article>"), F.lit('<div id="mw-content-text"><span class="mw-editsection">[edit]</span>'))
    html = F.replace(html, F.lit("</article>"), F.lit('<div class="x navbox"><a href="/n">next</a></div></div>'))
    return pages.withColumn("html", html)


def wiki_pages(spark, d):
    """Every document as an encyclopedia page: a heading and a paragraph per line inside the
    main element, with parts around and in it that are cut."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    html = F.concat(
        F.lit('<html><head><title>t</title></head><body><div id="mw-head"><p>top</div><div id="mw-content-text"><h2>'),
        F.col("source"), F.lit('<span class="x mw-editsection">[edit]</span></h2>'), body,
        F.lit('<table class="navbox"><tr><td>next<td>last</table></div><div id="footer">end</div></body></html>'))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), html.alias("html"),
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("doc_id").cast("string")).alias("url"))


@query("main_content", """
WITH safe AS (SELECT doc_id, source, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents)
SELECT doc_id AS page_id, '<div id="mw-content-text"><h2>' || source || '</h2><p>' || replace(t, chr(10), '</p><p>')
       || '</p></div>' AS content FROM safe""")
def main_content(spark, d):
    return main_content_job(wiki_pages(spark, d))


# Lines become paragraphs, so the Markdown can be written down in SQL: runs of blanks
# become one, lines without text go, the marks of Markdown are escaped, then the cleanup.
WIKI_PAGE_TEXTS = rf"""
lines AS (
  SELECT doc_id, source, list_filter(list_transform(str_split(text, chr(10)),
    lambda l: trim(regexp_replace(l, '[ \t\r\f]+', ' ', 'g'))), lambda l: l <> '') AS ls FROM documents),
md AS (
  SELECT doc_id, '## ' || source || chr(10) || chr(10) ||
         replace(replace(array_to_string(ls, chr(10) || chr(10)), '*', '\*'), '_', '\_') AS t FROM lines),
wiki_texts AS (
  SELECT doc_id, 'https://en.wikipedia.org/wiki/' || doc_id AS source_url, 'wiki' AS route, {_clean_sql('t')} AS content
  FROM md)"""


@query("wiki_markdown", f"WITH {WIKI_PAGE_TEXTS} SELECT source_url, route, content FROM wiki_texts")
def wiki_markdown(spark, d):
    return parse_pages(wiki_pages(spark, d)).select("source_url", "route", "content")


# Every document as a page of links, lists, tables, code, quotes and headings, one kind after
# another for its lines, some end tags left out; the Markdown of each kind is written down in SQL.
_RICH_LINES = r"""
lines AS (
  SELECT doc_id, list_filter(list_transform(str_split(text, chr(10)),
    lambda l: trim(regexp_replace(l, '[ \t\r\f]+', ' ', 'g'))), lambda l: l <> '') AS ls FROM documents)"""


def rich_pages(spark, d):
    safe = F.replace(F.replace(F.replace("l", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda l: F.trim(F.regexp_replace(l, "[ \t\r\f]+", " "))), lambda l: l != "")
    kinds = [
        ('<p><a href="/to?n=1&amp;m=2">', "</a> and<b> bold</b> <i>or not</i></p>"),
        ("<ul><li>", "</li><li>two<ul><li>inner</ul></ul>"),
        ('<ol start="3"><li>', "</li><li><em>four</em></li></ol>"),
        ("<table><thead><tr><th>n</th><th>text</thead><tr><td>1</td><td>", "</td></tr><tr><td>2</td><td>a|b</table>"),
        ("<pre>", "\n  x*y_z</pre>"),
        ("<blockquote><p>", "</p><p>said<br>twice</blockquote>"),
        ("<h3>", "</h3><p><code>a_b</code><hr>"),
    ]
    body = F.posexplode(lines).alias("n", "l")
    chosen = None
    for n, (before, after) in enumerate(kinds):
        made = F.concat(F.lit(before), safe, F.lit(after))
        at = F.col("n") % len(kinds) == n
        chosen = F.when(at, made) if chosen is None else chosen.when(at, made)
    parts = table(spark, d, "documents").select("doc_id", body).select("doc_id", F.struct("n", chosen.alias("made")).alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["made"]), "")
    return parts.groupBy("doc_id").agg(F.concat(F.lit("<html><body><script>var a='<p>';</script>"), whole).alias("html")).select(
        F.col("doc_id").alias("page_id"), "html", F.concat(F.lit("https://pages.example.com/"), F.col("doc_id").cast("string")).alias("url"))


@query("rich_markdown", rf"""
WITH {_RICH_LINES},
blocks AS (SELECT doc_id, list_transform(ls, lambda l, i: {{'i': i, 'raw': l, 'e': replace(replace(l, '*', '\*'), '_', '\_')}}) AS bs FROM lines),
md AS (
  SELECT doc_id, array_to_string(list_transform(bs, lambda b: CASE (b.i - 1) % 7
    WHEN 0 THEN '[' || b.e || '](/to?n=1&m=2) and **bold** *or not*'
    WHEN 1 THEN '- ' || b.e || chr(10) || '- two' || chr(10) || '  - inner'
    WHEN 2 THEN '3. ' || b.e || chr(10) || '4. *four*'
    WHEN 3 THEN '| n | text |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || replace(b.e, '|', '\|') || ' |' || chr(10) || '| 2 | a\|b |'
    WHEN 4 THEN '```python' || chr(10) || b.raw || chr(10) || '  x*y_z' || chr(10) || '```'
    WHEN 5 THEN '> ' || b.e || chr(10) || '>' || chr(10) || '> said' || chr(10) || '> twice'
    ELSE '### ' || b.e || chr(10) || chr(10) || '`a_b`' || chr(10) || chr(10) || '---' END), chr(10) || chr(10)) AS t
  FROM blocks WHERE len(bs) > 0)
SELECT 'https://pages.example.com/' || doc_id AS source_url, {_clean_sql('t')} AS content FROM md""")
def rich_markdown(spark, d):
    return parse_pages(rich_pages(spark, d)).select("source_url", "content")


# Words of the converted page against the words of the page stripped of its tags: the
# conversion must neither lose nor invent text. Addresses and list marks are not words of
# the page, so both sides keep letters only and the Markdown drops its link targets.
@query("markdown_words", f"""
WITH t AS (SELECT page_id, url, {strip_html_sql("regexp_replace(html, '&[a-z]+;', ' ', 'g')")} AS text FROM pages),
w AS (SELECT url, unnest(regexp_extract_all(text, '\\p{{L}}{{4,}}')) AS word FROM t)
SELECT url AS source_url, word, count(*) AS n FROM w GROUP BY ALL""")
def markdown_words(spark, d):
    pages = table(spark, d, "pages").withColumn("html", F.regexp_replace("html", "&[a-z]+;", " "))
    made = parse_pages(pages).select(
        "source_url", F.regexp_replace("content", r"\]\([^)\s]*\)", "]").alias("text"))
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}{4,})"), F.lit(1)))
    return made.select("source_url", found.alias("word")).groupBy("source_url", "word").agg(F.count("*").alias("n"))


@query("chunk_text", f"""
WITH {ARCHIVE}, w AS (SELECT id, str_split(crawled_text, ' ') AS words FROM archive WHERE crawled_text <> ''),
c AS (SELECT id, words, unnest(range(CAST(greatest(ceil((len(words) - 120) / 100.0), 0) AS BIGINT) + 1)) AS chunk_no FROM w)
SELECT id, CAST(chunk_no AS INTEGER) AS chunk_no,
       array_to_string(words[chunk_no * 100 + 1 : chunk_no * 100 + 120], ' ') AS chunk
FROM c""")
def chunk_text(spark, d):
    return K.chunks(fill_cores(archive(spark, d).select("id", "crawled_text")))


_WORDS = r"regexp_extract_all(lower(crawled_text), '[\p{L}\p{N}]+')"
_INDEX = f"""
{ARCHIVE}, tf AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest({_WORDS}) AS word FROM archive) GROUP BY ALL),
spread AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
keyword_index AS (SELECT id, word, round(n * ln((SELECT count(*) FROM archive) / df), 4) + 0.0 AS weight
                  FROM tf JOIN spread USING (word))"""


def _index(spark, d):
    return K.keyword_index(archive(spark, d).select("id", "crawled_text"))


def _stored_index(spark, d):
    return written(_index(spark, d), "keywords")


@query("keyword_index", f"WITH {_INDEX} SELECT id, word, weight FROM keyword_index")
def keyword_index(spark, d):
    return _index(spark, d)


@query("keyword_top", f"""
WITH {_INDEX} SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS INTEGER) AS rank FROM keyword_index)
WHERE rank <= 10""")
def keyword_top(spark, d):
    return K.top_words(_index(spark, d))


@query("keyword_cloud", f"""
WITH {_INDEX} SELECT word, count(*) AS blocks, CAST(round(sum(CAST(weight AS DECIMAL(18,4))), 2) AS DOUBLE) AS weight FROM keyword_index GROUP BY word""")
def keyword_cloud(spark, d):
    return K.keyword_cloud(_index(spark, d))


# The words of the benchmark passages are looked up.
@query("keyword_lookup", rf"""
WITH {_INDEX}, wanted AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM benchmark)
SELECT word, id, weight, source_url, title FROM keyword_index JOIN wanted USING (word) JOIN archive USING (id)""")
def keyword_lookup(spark, d):
    wanted = table(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word"))
    found = K.keyword_lookup(_stored_index(spark, d), archive(spark, d), wanted)
    return found.select("word", "id", "weight", "source_url", "title")


# Every benchmark passage as a question of several words, over all documents.
@query("search_words", rf"""
WITH {_INDEX}, asked AS (
  SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS word FROM benchmark),
sums AS (SELECT query_id, id, sum(CAST(weight AS DECIMAL(18,4))) AS score FROM asked JOIN keyword_index USING (word) GROUP BY ALL)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id,
         CAST(score AS DOUBLE) AS score FROM sums)
WHERE rank <= 10""")
def search_words_query(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return search_words(asked, build_postings(_index(spark, d)), 10)
