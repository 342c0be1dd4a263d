"""Queries over vectors: embedding, search, sampling, graph, contexts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks as B
from ..operators import graph as G
from ..operators import rag, rows
from ..operators import vectors as V
from ..operators.descent import descent_top_k
from ..operators.embed import embed
from ..operators.keywords import chunks
from ..operators.passages import passage_contexts, passages
from ..operators.search import FIRST_SAMPLE, RETRIEVE_K, TEXT_SEARCH_K, enrich, search_text, search_vectors
from ..operators.similarity import approx_top_k, build_index, open_index, recall, shown_score, top_k
from ..operators.signs import BITS, FLIPS, TABLES, build_signs, open_signs, sign_top_k
from ..operators.tree import build_tree, tree_top_k
from ..session import scratch_path, written
from ..sources.files import hit_lines, write_hits
from ..sources.ranges import scroll_ranges, write_ranges
from ..sources.tables import vector_table
from .catalog import ARCHIVE, archive, query, table
from .ingest import points_of, transfer_vectors


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _self(points):
    return points.select(F.col("id").alias("query_id"), "embedding")


def _entry(n):
    return F.round(F.element_at("embedding", n).cast("double"), 4) + F.lit(0.0)


def _rounded(hits):
    return hits.withColumn("score", shown_score(F.col("score")))


# --- payloads, embedding, vector table ------------------------------------------------

@query("payload_preview", f"""
WITH {ARCHIVE}
SELECT id AS block_id, title, description, source_url, left(crawled_text, 200) AS text_preview
FROM archive WHERE crawled_text <> ''""")
def payload_preview(spark, d):
    return B.payload_rows(archive(spark, d)).select("payload.*")


def _hashed_sql(source: str, key: str, text: str) -> str:
    """Non-zero entries of the hashed vector of each row, in the precision stored."""
    return rf"""
SELECT {key}, dim, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS x FROM (
  SELECT {key}, CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 384 AS INTEGER) AS dim, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS word FROM {source})
  GROUP BY {key}, dim)"""


@query("embed_hash", f"""
WITH v AS ({_hashed_sql('documents', 'doc_id', 'text')}) SELECT doc_id, dim, round(x, 4) AS x FROM v""")
def embed_hash(spark, d):
    made = embed(table(spark, d, "documents").select("doc_id", "text"), "text")
    return made.select("doc_id", F.posexplode("embedding").alias("dim", "x")).filter("x <> 0").select(
        "doc_id", "dim", F.round(F.col("x").cast("double"), 4).alias("x"))


@query("unit_vectors", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM e),
u AS (SELECT vec_id, unnest(e) / norm AS x, unnest(range(len(e))) AS dim FROM n)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x, 4) + 0.0 AS x FROM u""")
def unit_vectors(spark, d):
    # shown from the double form; the stored one is its float
    fit = table(spark, d, "embeddings").filter(V.is_vector(F.col("embedding"), 64))
    return fit.select("vec_id", V.unit(F.col("embedding")).alias("u")).select(
        "vec_id", F.posexplode("u").alias("dim", "x")).withColumn("x", F.round("x", 4) + F.lit(0.0))


@query("vector_upsert", """
WITH b AS (SELECT CASE WHEN label >= 5 THEN vec_id ELSE vec_id + 1000000 END AS id, list_reverse(embedding) AS e,
                  'new' AS origin FROM embeddings),
a AS (SELECT * FROM b UNION ALL
      SELECT vec_id, embedding, 'old' FROM embeddings WHERE vec_id NOT IN (SELECT id FROM b))
SELECT id, origin, round(CAST(e[1] AS DOUBLE), 4) + 0.0 AS head, round(CAST(e[64] AS DOUBLE), 4) + 0.0 AS tail FROM a""")
def vector_upsert(spark, d):
    e = table(spark, d, "embeddings")
    stored = e.select(F.col("vec_id").alias("id"), "embedding", F.lit("old").alias("origin"))
    batch = e.select(
        F.when(F.col("label") >= 5, F.col("vec_id")).otherwise(F.col("vec_id") + 1000000).alias("id"),
        F.reverse("embedding").alias("embedding"), F.lit("new").alias("origin"))

    return B.replace_by_id(stored, batch).select("id", "origin", _entry(1).alias("head"), _entry(64).alias("tail"))


@query("vector_table", rf"""
WITH {ARCHIVE}
, v AS ({_hashed_sql('archive', 'id', 'crawled_text')})
SELECT id, title, description, source_url, left(crawled_text, 200) AS text_preview, dim,
       CAST(round(x * 141.42) AS INTEGER) AS x
FROM archive JOIN v USING (id)""")
def vector_table_query(spark, d):
    from ..sources.tables import block_table
    blocks = block_table(spark, scratch_path(spark, "blocks"), buckets=8)
    none = F.lit(None).cast("string")
    rows_ = archive(spark, d).withColumns({
        "metadata": none, "full_json": none, "created_at": F.lit(None).cast("timestamp"),
        "updated_at": F.lit(None).cast("timestamp")})
    blocks.upsert(rows_, B.replace_parts)
    vectors = vector_table(spark, scratch_path(spark, "vectors"), buckets=8)
    transfer_vectors(blocks, vectors)
    return vectors.read().select(
        "id", "payload.title", "payload.description", "payload.source_url", "payload.text_preview",
        F.posexplode("embedding").alias("dim", "x")).filter("x <> 0").withColumn(
        "x", F.round(F.col("x").cast("double") * 141.42).cast("int"))


# --- search ---------------------------------------------------------------------------

def _ranked_sql(k: int, pairs: str) -> str:
    return f"""
scored AS ({pairs}),
hits AS (SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) + 0.0 DESC, id) AS INTEGER) AS rank
  FROM scored) WHERE rank <= {k})"""


_ALL_PAIRS = """
  SELECT q.vec_id AS query_id, p.vec_id AS id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings p"""


def _topk_sql(k: int) -> str:
    return f"WITH {_ranked_sql(k, _ALL_PAIRS)} SELECT query_id, rank, id, round(score, 4) + 0.0 AS score FROM hits"


@query("search_topk", _topk_sql(10))
def search_topk(spark, d):
    points = _points(spark, d)
    return _rounded(top_k(_self(points), points, 10))


@query("search_cells", _topk_sql(5))
def search_cells(spark, d):
    points = _points(spark, d)
    return _rounded(tree_top_k(_self(points), build_tree(points, k_max=5, leaf=200, fan=16), 5))


# Nearest-cell search has an exact answer too once the pivots are fixed: the first
# sixteen points in md5 order, four cells per query.
_CELLS = """
piv AS (SELECT CAST(row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS INTEGER) - 1 AS cell, embedding AS pe
        FROM embeddings ORDER BY 1 LIMIT 16),
near AS (SELECT vec_id, embedding, cell, row_number() OVER (PARTITION BY vec_id ORDER BY
           list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(pe AS DOUBLE[])) DESC, cell) AS n FROM embeddings, piv)"""


@query("search_approx", f"""
WITH {_CELLS}, {_ranked_sql(5, '''
  SELECT q.vec_id AS query_id, p.vec_id AS id,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score
  FROM near q JOIN near p ON q.cell = p.cell AND q.n <= 4 AND p.n = 1''')}
SELECT query_id, rank, id, round(score, 4) + 0.0 AS score FROM hits""")
def search_approx(spark, d):
    points, path = _points(spark, d), scratch_path(spark, "index")
    build_index(points, k_max=5, pivots=16, path=path)
    return _rounded(approx_top_k(_self(points), open_index(spark, path), 5, probes=4))


@query("search_recall", f"""
WITH {_CELLS}, {_ranked_sql(5, _ALL_PAIRS)},
probed AS (
  SELECT q.vec_id AS query_id, p.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
           round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 4) + 0.0 DESC,
           p.vec_id) AS n
  FROM near q JOIN near p ON q.cell = p.cell AND q.n <= 4 AND p.n = 1)
SELECT round((SELECT count(*) FROM hits JOIN probed USING (query_id, id) WHERE probed.n <= 5) / count(*), 4) AS recall
FROM hits""")
def search_recall(spark, d):
    points = _points(spark, d)
    index = build_index(points, k_max=5, pivots=16)
    return recall(approx_top_k(_self(points), index, 5, probes=4), top_k(_self(points), points, 5))


_SIGNS = f"""
planes AS (
  SELECT t, b, d, CASE WHEN CAST('0x' || substr(md5(t || '-' || b || '-' || d), 1, 8) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END AS x
  FROM range({TABLES}) AS t(t), range({BITS}) AS b(b), range(64) AS d(d)),
entries AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
signs AS (
  SELECT vec_id, t, sum(CASE WHEN product > 0 THEN CAST(1 AS BIGINT) << CAST(b AS INTEGER) ELSE 0 END)::BIGINT AS sig
  FROM (SELECT vec_id, t, b, sum(e * x) AS product FROM entries JOIN planes USING (d) GROUP BY ALL) GROUP BY ALL),
met AS (SELECT DISTINCT q.vec_id AS query_id, p.vec_id AS id
        FROM signs q JOIN signs p ON q.t = p.t AND bit_count(xor(q.sig, p.sig)) <= {FLIPS})"""
_MET_PAIRS = """
  SELECT met.query_id, met.id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score
  FROM met JOIN embeddings q ON q.vec_id = met.query_id JOIN embeddings p ON p.vec_id = met.id"""


@query("search_lsh", f"""
WITH {_SIGNS}, {_ranked_sql(5, _MET_PAIRS)}
SELECT query_id, rank, id, round(score, 4) + 0.0 AS score FROM hits""")
def search_lsh(spark, d):
    points, path = _points(spark, d), scratch_path(spark, "signs")
    build_signs(points, k_max=5, path=path)
    return _rounded(sign_top_k(_self(points), open_signs(spark, path), 5))


@query("search_lsh_recall", f"""
WITH {_SIGNS}, {_ranked_sql(5, _ALL_PAIRS)},
probed AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) + 0.0 DESC, id) AS n FROM ({_MET_PAIRS}))
SELECT round((SELECT count(*) FROM hits JOIN probed USING (query_id, id) WHERE probed.n <= 5) / count(*), 4) AS recall
FROM hits""")
def search_lsh_recall(spark, d):
    points = _points(spark, d)
    found = sign_top_k(_self(points), build_signs(points, k_max=5), 5)
    return recall(found, top_k(_self(points), points, 5))


_HASHED = f"""
docs AS ({_hashed_sql('documents', 'doc_id', 'text')}),
asked AS ({_hashed_sql('benchmark', 'item_id', 'text')}),
lengths AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM docs GROUP BY doc_id),
asked_lengths AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM asked GROUP BY item_id)"""
_TEXT_PAIRS = """
  SELECT pairs.item_id AS query_id, CAST(pairs.doc_id AS VARCHAR) AS id,
         coalesce(dots.dot, 0.0) / (l.n * a.n) AS score
  FROM (SELECT item_id, doc_id FROM asked_lengths, lengths) pairs
  LEFT JOIN (SELECT item_id, doc_id, sum(docs.x * asked.x) AS dot FROM docs JOIN asked USING (dim) GROUP BY ALL) dots
    USING (item_id, doc_id)
  JOIN lengths l ON l.doc_id = pairs.doc_id JOIN asked_lengths a ON a.item_id = pairs.item_id"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _text_hits(spark, d, k):
    # the points stand for a stored table: embedded once, then searched and looked up
    return search_text(_questions(spark, d), written(points_of(archive(spark, d)), "points"), k)


@query("search_text", f"""
WITH {ARCHIVE}, {_HASHED}, {_ranked_sql(TEXT_SEARCH_K, _TEXT_PAIRS)}
SELECT query_id, rank, id AS block_id, round(score, 4) + 0.0 AS score, title, description, source_url,
       left(crawled_text, 200) AS text_preview
FROM hits JOIN archive USING (id)""")
def search_text_query(spark, d):
    return _rounded(_text_hits(spark, d, TEXT_SEARCH_K)).select(
        "query_id", "rank", "block_id", "score", "title", "description", "source_url", "text_preview")


@query("search_chunks", rf"""
WITH {ARCHIVE}, w AS (SELECT id, str_split(crawled_text, ' ') AS words FROM archive WHERE crawled_text <> ''),
c AS (SELECT id, words, unnest(range(CAST(greatest(ceil((len(words) - 120) / 100.0), 0) AS BIGINT) + 1)) AS chunk_no FROM w),
parts AS (SELECT id || '#' || chunk_no AS doc_id, array_to_string(words[chunk_no * 100 + 1 : chunk_no * 100 + 120], ' ') AS text FROM c),
docs AS ({_hashed_sql('parts', 'doc_id', 'text')}),
asked AS ({_hashed_sql('benchmark', 'item_id', 'text')}),
lengths AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM docs GROUP BY doc_id),
asked_lengths AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM asked GROUP BY item_id),
{_ranked_sql(3, _TEXT_PAIRS)}
SELECT query_id, rank, id, round(score, 4) + 0.0 AS score FROM hits""")
def search_chunks(spark, d):
    parts = chunks(archive(spark, d).select("id", "crawled_text"))
    named = parts.select(F.concat("id", F.lit("#"), F.col("chunk_no").cast("string")).alias("id"), "chunk")
    asked = embed(_questions(spark, d), "question").select("query_id", "embedding")
    return _rounded(top_k(asked, embed(named, "chunk").select("id", "embedding"), 3))


@query("enrich_hits", f"""
WITH {_ranked_sql(10, _ALL_PAIRS)}
SELECT query_id, rank, hits.id, round(score, 4) + 0.0 AS score, url, html
FROM hits LEFT JOIN pages ON page_id = hits.id""")
def enrich_hits(spark, d):
    points = _points(spark, d)
    full = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", "html")
    return _rounded(enrich(top_k(_self(points), points, 10), full))


_HIT_LINES = """
  'Score: ' || format('{:.3f}', score) || chr(10) || 'Title: ' || coalesce(title, 'None') || chr(10) ||
  'URL: ' || coalesce(source_url, 'None') || chr(10) || 'Preview: ' || left(crawled_text, 200) || '...'"""


@query("format_hits", f"""
WITH {ARCHIVE}, {_HASHED}, {_ranked_sql(TEXT_SEARCH_K, _TEXT_PAIRS)}
SELECT query_id, rank, {_HIT_LINES} AS line FROM hits JOIN archive USING (id)""")
def format_hits(spark, d):
    return _text_hits(spark, d, TEXT_SEARCH_K).select("query_id", "rank", hit_lines().alias("line"))


@query("result_files", f"""
WITH {ARCHIVE}, {_HASHED}, {_ranked_sql(TEXT_SEARCH_K, _TEXT_PAIRS)}
SELECT 'json' AS form, concat_ws(' ', query_id, rank, id, title, source_url, left(crawled_text, 200)) AS line,
       round(score, 4) + 0.0 AS score FROM hits JOIN archive USING (id) UNION ALL
SELECT 'text', line, NULL FROM (SELECT unnest(string_split({_HIT_LINES}, chr(10) || chr(10))) AS line
                                FROM hits JOIN archive USING (id)) WHERE line <> ''""")
def result_files(spark, d):
    found = _text_hits(spark, d, TEXT_SEARCH_K)
    path = scratch_path(spark, "hits")
    write_hits(found, path + "/json", "json")
    write_hits(found, path + "/text", "text")
    as_json = spark.read.schema(found.schema).json(path + "/json").select(
        F.lit("json").alias("form"),
        F.concat_ws(" ", "query_id", "rank", "block_id", "title", "source_url", "text_preview").alias("line"),
        shown_score(F.col("score")).alias("score"))
    as_text = spark.read.option("lineSep", "\n\n").text(path + "/text").filter("value <> ''")
    return as_json.union(as_text.select(F.lit("text"), "value", F.lit(None).cast("double")))


@query("search_with_vector", f"""
WITH {_ranked_sql(3, _ALL_PAIRS)}
SELECT query_id, rank, id, round(score, 4) + 0.0 AS score, 'v' || id AS title,
       round(CAST(embedding[1] AS DOUBLE), 4) + 0.0 AS head, round(CAST(embedding[64] AS DOUBLE), 4) + 0.0 AS tail
FROM hits JOIN embeddings ON vec_id = id""")
def search_with_vector(spark, d):
    points = _points(spark, d).withColumn("payload", F.struct(F.concat(F.lit("v"), F.col("id").cast("string")).alias("title")))
    found = search_vectors(_self(points), points, 3, with_vector=True)
    return _rounded(found).select("query_id", "rank", "id", "score", "title", _entry(1).alias("head"), _entry(64).alias("tail"))


# --- samples and scrolling ------------------------------------------------------------

@query("sample_points", """
SELECT page_id AS id, url FROM pages ORDER BY md5('7:' || page_id), page_id LIMIT 20""")
def sample_points(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return rows.random_sample(pages, 20, seed=7)


@query("scroll_points", """
SELECT page_id AS id, url, (SELECT min(page_id) FROM pages WHERE page_id >= 20) AS next_offset
FROM pages WHERE page_id >= 10 ORDER BY page_id LIMIT 10""")
def scroll_points(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return rows.scroll(pages, 10, 10)


@query("scroll_vectors", """
SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 4) + 0.0 AS head, round(CAST(embedding[64] AS DOUBLE), 4) + 0.0 AS tail,
       (SELECT min(vec_id) FROM embeddings WHERE vec_id >= 20) AS next_offset
FROM embeddings WHERE vec_id >= 10 ORDER BY vec_id LIMIT 10""")
def scroll_vectors(spark, d):
    return rows.scroll(_points(spark, d), 10, 10).select("id", _entry(1).alias("head"), _entry(64).alias("tail"), "next_offset")


# Whole documents stored by ranges of their id: three pages, each from where the one before ends.
@query("scroll_ranges", """
WITH numbered AS (SELECT doc_id AS id, text, lang, source, row_number() OVER (ORDER BY doc_id) AS n,
                         lead(doc_id) OVER (ORDER BY doc_id) AS following FROM documents WHERE doc_id >= 20),
pages AS (SELECT *, (n - 1) // 25 AS page FROM numbered WHERE n <= 75)
SELECT CAST(page AS INTEGER) AS page, id, text, lang, source,
       max(CASE WHEN n % 25 = 0 THEN following END) OVER (PARTITION BY page) AS next_offset FROM pages""")
def scroll_ranges_query(spark, d):
    path = scratch_path(spark, "ranges")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    write_ranges(docs, path, rows_per_file=100)
    found, offset = None, 20
    for number in range(3):
        page = scroll_ranges(spark, path, offset, 25).withColumn("page", F.lit(number))
        found = page if found is None else found.unionByName(page)
        offset = page.agg(F.max("next_offset")).first()[0]
        if offset is None:
            break
    return found


# --- graph ----------------------------------------------------------------------------

@query("graph_nodes", f"""
WITH {ARCHIVE}
SELECT id, coalesce(nullif(CASE WHEN description = 'de' THEN '' ELSE title END, ''), 'Untitled') AS title,
       coalesce(nullif(description, ''), 'No description') AS description, source_url AS url,
       source_url || '?square' AS image, CASE WHEN description = 'fr' THEN source_url || '?large' END AS "imageLarge"
FROM archive WHERE crawled_text <> ''""")
def graph_nodes(spark, d):
    blocks = archive(spark, d).withColumn("title", F.when(
        F.coalesce(F.col("description"), F.lit("")) == "de", "").otherwise(F.col("title")))
    raw = archive(spark, d).select("id", F.when(F.col("source_url").isNotNull(), F.struct(
        F.struct(F.concat("source_url", F.lit("?square")).alias("url")).alias("square"),
        F.when(F.col("description") == "fr", F.struct(F.concat("source_url", F.lit("?large")).alias("url"))).alias("large"),
    )).alias("image"))
    return G.node_rows(B.payload_rows(blocks), raw)


_LINKS = "SELECT query_id AS source, id AS target, round(score, 4) + 0.0 AS value FROM hits"


@query("knn_graph", f"WITH {_ranked_sql(10, _ALL_PAIRS)} {_LINKS}")
def knn_graph(spark, d):
    return G.neighbour_links(_points(spark, d), 10).withColumn("value", shown_score(F.col("value")))


@query("knn_graph_others", f"WITH {_ranked_sql(10, _ALL_PAIRS + ' WHERE q.vec_id <> p.vec_id')} {_LINKS}")
def knn_graph_others(spark, d):
    return G.neighbour_links(_points(spark, d), 10, keep_self=False).withColumn("value", shown_score(F.col("value")))


@query("knn_descent")
def knn_descent(spark, d):
    return G.descent_links(_points(spark, d), 10).withColumn("value", shown_score(F.col("value")))


# Which links are found is left to the descent; that nine of ten are there, and that each point
# has its ten, is not.
@query("knn_descent_recall", """
SELECT count(*) AS points, 10 * count(*) AS links, true AS near_complete FROM embeddings""")
def knn_descent_recall(spark, d):
    points = _points(spark, d)
    found = written(descent_top_k(points, 10), "found")
    share = recall(found, top_k(_self(points), points, 10)).select((F.col("recall") >= 0.9).alias("near_complete"))
    return found.agg(F.count_distinct("query_id").alias("points"), F.count("*").alias("links")).crossJoin(share)


@query("new_nodes", """
SELECT vec_id AS id, 'old' AS origin FROM embeddings UNION ALL
SELECT doc_id, 'found' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def new_nodes(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("old").alias("origin"))
    found = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("found").alias("origin"))
    return G.union_nodes(old, found)


@query("append_links", f"""
WITH {_ranked_sql(10, _ALL_PAIRS)}, l AS (
  SELECT query_id AS source, id AS target, round(score, 4) + 0.0 AS value FROM hits UNION ALL
  SELECT query_id, id, round(score, 4) + 0.0 FROM hits WHERE rank <= 5)
SELECT source, target, value, count(*) AS copies FROM l GROUP BY ALL""")
def append_links(spark, d):
    points = _points(spark, d)
    hits = top_k(_self(points), points, 10)
    both = G.append_links(G.links(hits), G.links(hits, k=5))
    return both.withColumn("value", shown_score(F.col("value"))).groupBy("source", "target", "value").agg(
        F.count("*").alias("copies"))


@query("expand_hops", f"""
WITH {_ranked_sql(5, _ALL_PAIRS)},
h0 AS (SELECT vec_id AS start, vec_id AS id FROM embeddings),
h1 AS (SELECT DISTINCT start, hits.id FROM h0 JOIN hits ON query_id = h0.id
       WHERE (start, hits.id) NOT IN (SELECT (start, id) FROM h0)),
h2 AS (SELECT DISTINCT start, hits.id FROM h1 JOIN hits ON query_id = h1.id
       WHERE (start, hits.id) NOT IN (SELECT (start, id) FROM h0 UNION ALL SELECT (start, id) FROM h1))
SELECT start, id, 0 AS hop FROM h0 UNION ALL SELECT start, id, 1 FROM h1 UNION ALL SELECT start, id, 2 FROM h2""")
def expand_hops(spark, d):
    points = _points(spark, d)
    return G.expand(points.select("id"), G.neighbour_links(points, 5), 2)


# The first sample of nodes is shown and expanded twice; only the frontier is searched.
@query("expand_nodes", f"""
WITH {_ranked_sql(5, _ALL_PAIRS)},
h0 AS (SELECT vec_id AS id FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT {FIRST_SAMPLE}),
h1 AS (SELECT DISTINCT hits.id FROM h0 JOIN hits ON query_id = h0.id WHERE hits.id NOT IN (SELECT id FROM h0))
SELECT query_id AS source, hits.id AS target, round(score, 4) + 0.0 AS value, CAST(1 AS INTEGER) AS hop
FROM hits JOIN h0 ON query_id = h0.id UNION ALL
SELECT query_id, hits.id, round(score, 4) + 0.0, 2 FROM hits JOIN h1 ON query_id = h1.id""")
def expand_nodes(spark, d):
    points = _points(spark, d)
    starts = rows.random_sample(points.select("id"), FIRST_SAMPLE)
    return G.expand_nodes(starts, points, 5, 2).withColumn("value", shown_score(F.col("value")))


# --- contexts and prompts -------------------------------------------------------------

_ENTRY = """'Document ' || rank || ':' || chr(10) || 'Title: ' || coalesce(title, 'None') || chr(10) ||
  'URL: ' || coalesce(source_url, 'None') || chr(10) || 'Content: ' || left(crawled_text, 200) || chr(10)"""
_CONTEXT = f"""
{ARCHIVE}, {_HASHED}, {_ranked_sql(RETRIEVE_K, _TEXT_PAIRS)},
contexts AS (SELECT query_id, string_agg({_ENTRY}, chr(10) || chr(10) ORDER BY rank) AS context
             FROM hits JOIN archive USING (id) GROUP BY query_id)"""


@query("rag_context", f"WITH {_CONTEXT} SELECT query_id, context FROM contexts")
def rag_context(spark, d):
    return rag.contexts(_text_hits(spark, d, RETRIEVE_K))


@query("rag_prompt", f"""
WITH {_CONTEXT}
SELECT item_id AS query_id, coalesce(context, '') AS context,
       'Below are passages from the archive, each with its title and address.' || chr(10) || chr(10) ||
       coalesce(context, '') || chr(10) || chr(10) ||
       'Using only these passages, answer the question that follows. Quote where it helps, name the' || chr(10) ||
       'address of every passage you rely on, and say so if the passages do not hold the answer.' || chr(10) || chr(10) ||
       'Question: ' || text || chr(10) || 'Answer:' AS prompt
FROM benchmark LEFT JOIN contexts ON query_id = item_id""")
def rag_prompt(spark, d):
    return rag.prompts(_questions(spark, d), rag.contexts(_text_hits(spark, d, RETRIEVE_K)))


# Contexts from fragments: the six best chunks of each benchmark passage over whole documents,
# put together where they overlap. Chunks have 30 words, one every 20.
@query("chunk_contexts", rf"""
WITH {ARCHIVE}, w AS (SELECT id, str_split(crawled_text, ' ') AS words FROM archive WHERE crawled_text <> ''),
c AS (SELECT id, words, unnest(range(CAST(greatest(ceil((len(words) - 30) / 20.0), 0) AS BIGINT) + 1)) AS chunk_no FROM w),
parts AS (SELECT id || '#' || chunk_no AS doc_id, array_to_string(words[chunk_no * 20 + 1 : chunk_no * 20 + 30], ' ') AS text FROM c),
docs AS ({_hashed_sql('parts', 'doc_id', 'text')}),
asked AS ({_hashed_sql('benchmark', 'item_id', 'text')}),
lengths AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM docs GROUP BY doc_id),
asked_lengths AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM asked GROUP BY item_id),
{_ranked_sql(6, _TEXT_PAIRS)},
hit AS (SELECT query_id, split_part(id, '#', 1) AS id, CAST(split_part(id, '#', 2) AS BIGINT) AS chunk_no, round(score, 4) + 0.0 AS score FROM hits),
stepped AS (SELECT *, chunk_no - lag(chunk_no) OVER (PARTITION BY query_id, id ORDER BY chunk_no) AS gap FROM hit),
islands AS (SELECT *, sum(CASE WHEN gap <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, id ORDER BY chunk_no) AS island FROM stepped),
found AS (SELECT query_id, id, min(chunk_no) AS a, max(chunk_no) AS b, max(score) AS score FROM islands GROUP BY query_id, id, island),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, a) AS rank FROM found)
SELECT query_id, string_agg('Document ' || rank || ':' || chr(10) || 'Title: ' || coalesce(title, 'None') || chr(10) || 'URL: '
         || coalesce(source_url, 'None') || chr(10) || 'Content: ' || array_to_string(words[a * 20 + 1 : b * 20 + 30], ' ') || chr(10),
         chr(10) || chr(10) ORDER BY rank) AS context
FROM best JOIN w USING (id) JOIN archive USING (id) WHERE rank <= 3 GROUP BY query_id""")
def chunk_contexts(spark, d):
    blocks = archive(spark, d)
    parts = chunks(blocks.select("id", "crawled_text"), width=30, step=20)
    named = parts.select(F.concat("id", F.lit("#"), F.col("chunk_no").cast("string")).alias("id"), "chunk")
    asked = embed(_questions(spark, d), "question").select("query_id", "embedding")
    found = _rounded(top_k(asked, embed(named, "chunk").select("id", "embedding"), 6))
    hits = found.select("query_id", F.split_part("id", F.lit("#"), F.lit(1)).alias("id"),
                        F.split_part("id", F.lit("#"), F.lit(2)).cast("int").alias("chunk_no"), "score")
    return passage_contexts(passages(hits, parts, 30, 20), blocks)


# The flagship: every vector's ten nearest with the page behind each hit.
def flagship(spark, d):
    points = _points(spark, d)
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return _rounded(enrich(top_k(_self(points), points, 10), pages))
