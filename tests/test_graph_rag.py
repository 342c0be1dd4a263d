from helpers import tuples
from pyspark.sql import functions as F

from gleanbase.operators import graph as G
from gleanbase.operators import keywords as K
from gleanbase.operators import rag, reports

HITS = "query_id string, rank int, id string, score double"


def hits(spark):
    return spark.createDataFrame([("a", 1, "a", 1.0), ("a", 2, "b", 0.5), ("a", 3, "c", 0.4), ("b", 1, "b", 1.0), ("b", 2, "d", 0.9),
                                  ("d", 1, "d", 1.0), ("d", 2, "a", 0.3)], HITS)


def test_links(spark):
    assert G.links(hits(spark)).count() == 7
    others = G.links(hits(spark), keep_self=False, k=1)
    assert tuples(others, "source", "target", "value") == [("a", "b", 0.5), ("b", "d", 0.9), ("d", "a", 0.3)]
    twice = G.append_links(G.links(hits(spark)), others)
    assert twice.count() == 10 and G.append_links(G.links(hits(spark)), others, distinct=True).count() == 7


def test_expand(spark):
    out = G.expand(spark.createDataFrame([("a",), ("d",), ("z",)], "id string"), G.links(hits(spark)), 2)
    assert tuples(out, "start", "id", "hop") == [
        ("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("d", "a", 1), ("d", "b", 2), ("d", "c", 2), ("d", "d", 0), ("z", "z", 0)]


def test_nodes(spark):
    points = spark.createDataFrame([("1", [1.0], ("", None, "u")), ("2", [2.0], ("t", "d", None))],
                                   "id string, embedding array<float>, payload struct<title:string,description:string,source_url:string>")
    raw = spark.createDataFrame([(1, (("s",), None))], "id long, image struct<square:struct<url:string>,large:struct<url:string>>")
    nodes = G.node_rows(points, raw)
    assert tuples(nodes, "id", "title", "description", "url", "image", "imageLarge") == [
        ("1", "Untitled", "No description", "u", "s", None), ("2", "t", "d", None, None, None)]
    assert tuples(G.union_nodes(nodes.filter("id = '1'"), nodes), "id") == [("1",), ("2",)]


def test_contexts_and_prompts(spark):
    found = hits(spark).withColumns({"title": F.col("id"), "source_url": F.lit("u"), "text_preview": F.concat("id", F.lit("!"))})
    ctx = rag.contexts(found)
    entry = "Document {}:\nTitle: {}\nURL: u\nContent: {}!\n"
    assert dict(tuples(ctx, "query_id", "context"))["a"] == "\n\n".join(entry.format(n, i, i) for n, i in enumerate("abc", 1))
    asked = spark.createDataFrame([("a", "why {context}?"), ("q", "none")], "query_id string, question string")
    made = dict(tuples(rag.prompts(asked, ctx, "C={context} Q={question}."), "query_id", "prompt"))
    assert made["q"] == "C= Q=none." and made["a"].endswith(" Q=why {context}?.")


def test_chunks_cover_the_text(spark):
    words = [str(n) for n in range(1005)]
    df = spark.createDataFrame([("1", " ".join(words)), ("2", "a b"), ("3", ""), ("4", None)], "id string, crawled_text string")
    parts = {(r["id"], r["chunk_no"]): r["chunk"].split(" ") for r in K.chunks(df, width=120, step=100).collect()}
    mine = [parts[("1", n)] for n in range(sum(k[0] == "1" for k in parts))]
    assert [w for p in mine[:-1] for w in p[:100]] + mine[-1] == words and parts[("2", 0)] == ["a", "b"] and len(parts) == len(mine) + 1


def test_keywords_with_a_word_in_every_block(spark):
    df = spark.range(60).select(F.col("id").cast("string"), F.concat(F.lit("common word"), F.col("id").cast("string"), F.lit(" pair"),
                                                                       (F.col("id") / 2).cast("int").cast("string")).alias("crawled_text"))
    plain = K.top_words(K.keyword_index(df), 3)
    hot = K.top_words(K.keyword_index(df, share=0.1, rows=5), 3)
    assert tuples(plain, "id", "word", "weight", "rank") == tuples(hot, "id", "word", "weight", "rank")
    cloud = dict(tuples(K.keyword_cloud(plain), "word", "blocks"))
    assert cloud["common"] == 60 and cloud["word7"] == 1 and cloud["pair3"] == 2
    stored = plain.cache()
    assert tuples(K.keyword_lookup(stored, df, ["pair3"]), "id") == [("6",), ("7",)]
    assert tuples(K.keyword_lookup(stored, df, spark.createDataFrame([("pair3",)], "word string")), "id") == [("6",), ("7",)]


def test_reports(spark):
    df = spark.createDataFrame([("1", "https://a/x", None), ("2", "https://a/x", ""), ("3", "", "t"), ("4", None, None), ("5", "https://a/x", None)],
                               "id string, source_url string, crawled_text string")
    assert tuple(reports.stage_counts(df).first()) == (5, 3, 2, 1, 1)
    assert tuples(reports.quality_by_site(df), "site", "blocks", "without_text", "empty_text") == [(":///", 2, 1, 0), ("https://a/", 3, 2, 1)]
    assert tuples(reports.missing_since(df, df.filter("id < '3'")), "id") == [("3",), ("4",), ("5",)]


def test_small_inputs_fill_the_cores(spark, sf, tmp_path):
    from gleanbase.operators.spread import fill_cores, scanned_bytes
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < scanned_bytes(docs) < 10 << 20
    plan = fill_cores(docs)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(8)" in plan
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    assert fill_cores(docs) is docs
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_expand_nodes_searches_the_frontier_only(spark, monkeypatch):
    points = spark.range(60).select(F.col("id").cast("string").alias("id"), F.array(
        F.cos(F.col("id") / 10).cast("float"), F.sin(F.col("id") / 10).cast("float")).alias("embedding"))
    asked, plain = [], G.top_k
    monkeypatch.setattr(G, "top_k", lambda q, p, k: (asked.append(q.count()), plain(q, p, k))[1])
    starts = spark.createDataFrame([("7",), ("7",), ("30",), ("nope",), (None,)], "id string")
    got = G.expand_nodes(starts, points, 3, 2)
    assert asked == [2, 4]  # the starts, then their neighbours, not all points
    monkeypatch.setattr(G, "top_k", plain)
    edges = G.neighbour_links(points, 3)
    reached = G.expand(starts.filter("id IN ('7', '30')"), edges, 1).select("id").distinct()
    want = edges.join(reached.withColumnRenamed("id", "source"), "source", "left_semi")
    assert tuples(got, "source", "target", "value") == tuples(want, "source", "target", "value")


def test_salted_joins_keep_columns_of_their_own_names(spark):
    from pyspark.sql import functions as F

    from gleanbase.operators.skew import salted_join, spread_join
    left = spark.createDataFrame([(n % 3, n, f"s{n}", "h") for n in range(9)], "k long, v long, _salt string, _hot string")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string")
    hot = spark.createDataFrame([(0, 9)], "k long, n long")
    for made in (salted_join(left, right, "k", "left", F.col("v")), salted_join(left, right, "k", "left", F.col("v"), hot=hot),
                 spread_join(left, right, "k", "left", F.col("v"))):
        assert made.columns == ["k", "v", "_salt", "_hot", "w"]
        assert tuples(made, "v", "_salt", "_hot", "w") == [(n, f"s{n}", "h", {0: "a", 1: "b"}.get(n % 3)) for n in range(9)]
