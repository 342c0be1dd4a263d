import datetime as dt
import json

from helpers import tuples
from pyspark.sql import functions as F

from gleanbase import schemas
from gleanbase.operators import blocks as B
from gleanbase.plans import ingest
from gleanbase.session import scratch_path
from gleanbase.sources.files import write_hits
from gleanbase.sources.tables import block_table, vector_table
from gleanbase.streaming.ingest import landed_records, start_ingest

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
CHANNEL = "channel string, page long, pos int, id string, title string, description string, metadata string, source struct<url:string,content_type:string>"


def tables(spark):
    return block_table(spark, scratch_path(spark, "b"), buckets=2), vector_table(spark, scratch_path(spark, "v"), dim=384, buckets=2)


def test_ingest_keeps_text_and_parses_once(spark):
    one = spark.createDataFrame([("a", 1, 0, "1", "first", None, None, ("https://a/1", None)), ("a", 1, 1, "2", "x", None, None, None),
                                 ("a", 1, 2, "3", "pdf", None, None, ("https://a/f.pdf", None))], CHANNEL)
    two = spark.createDataFrame([("b", 1, 0, "1", "second", None, None, ("https://a/1", None)), ("b", 1, 1, "4", "lost", None, None, ("https://a/4", None))], CHANNEL)
    pages = spark.createDataFrame([(1, "https://a/1", "<p>words here</p>", None), (4, "https://a/4", "", None)], schemas.PAGE)
    blocks, vectors = tables(spark)
    counts = ingest.Counts()
    errors = ingest.ingest_channels([one, two], pages, blocks, vectors, T0, counts=counts)
    assert counts.get() == {"blocks": 4, "with_url": 3, "parsed": 2, "failed": 1, "with_text": 1}
    assert tuples(errors, "source_url", "error") == [("https://a/4", "no content")]
    assert tuples(blocks.read(), "id", "title", "crawled_text") == [("1", "second", "words here"), ("3", "pdf", None), ("4", "lost", None)]
    assert tuples(vectors.read(), "id", "payload.title", "payload.text_preview") == [("1", "second", "words here")]
    # a later run without the page keeps the stored text and does not ask for it
    latest, pending = ingest.to_parse([one, two], blocks)
    assert tuples(pending, "id") == [("2",), ("3",), ("4",)]
    ingest.ingest_channels([one], pages.limit(0), blocks, None, T1)
    assert tuples(blocks.read(), "id", "title", "crawled_text", "created_at", "updated_at") == [
        ("1", "first", "words here", T0, T1), ("3", "pdf", None, T0, T1), ("4", "lost", None, T0, T0)]
    ingest.ingest_channels([one], pages, blocks, None, T1, upsert_mode="overwrite")
    assert tuples(blocks.read().filter("id = '1'"), "crawled_text") == [(None,)]
    assert ingest.to_parse([one, two], blocks, "pdf_only")[0].select("id").collect()[0][0] == "3"


def test_sync_uses_own_content(spark):
    rows = spark.createDataFrame([("Maps", 1, 0, "1", "in", None, "{}", ("u", None), "2024-01-02T00:00:00Z", "own"),
                                  ("Maps", 1, 1, "2", "edge", None, "{}", None, "2024-01-01T00:00:00Z", "own"),
                                  ("Other", 1, 0, "3", "in", None, "{}", None, "2024-01-02T00:00:00Z", "own")],
                                 CHANNEL + ", created_at string, content string")
    blocks, _ = tables(spark)
    ingest.sync_channels([rows], blocks, T0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), ["Maps"])
    assert tuples(blocks.read(), "id", "crawled_text", "metadata", "source_url") == [("1", "own", "", "u")]


def record(n, **more):
    return {"url": f"https://a/{n}", "title": f"t{n}", "content": f"text number {n}", "submitted_at": "2024-01-02T03:04:05Z", **more}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for f in range(3):
        lines = [record(f * 3 + i) for i in range(3)] + [record(0, title=f"again {f}", submitted_at=f"2024-01-02T03:04:05.{f}00Z")]
        (landing / f"{f}.json").write_text("\n".join(json.dumps(r) for r in lines))
    blocks, vectors = tables(spark)
    args = (blocks, vectors, str(tmp_path / "cp"), str(tmp_path / "rejects"))
    seen = {}
    start_ingest(landed_records(spark, str(landing), max_files=1), *args, on_counts=seen.__setitem__).awaitTermination()
    assert sorted(seen) == [0, 1, 2] and {c["accepted"] for c in seen.values()} == {4}
    assert sorted(c["blocks"] for c in seen.values()) == [3, 4, 4]  # one file has a record twice
    whole_b, whole_v = tables(spark)
    ingest.ingest_records(spark.read.schema(schemas.SUBMISSION).json(str(landing)), whole_b, whole_v)
    names = ["id", "source_url", "crawled_text", "metadata"]
    assert tuples(blocks.read(), *names) == tuples(whole_b.read(), *names) and blocks.read().count() == 9
    assert tuples(vectors.read(), "id", "embedding") == tuples(whole_v.read(), "id", "embedding")
    (landing / "3.json").write_text(json.dumps(record(50)) + "\n" + json.dumps(record(51, content=None)))
    start_ingest(landed_records(spark, str(landing), max_files=1), *args).awaitTermination()
    assert blocks.read().count() == 10
    assert tuples(spark.read.json(str(tmp_path / "rejects")), "title", "reason") == [("t51", "no content")]


def test_replayed_batch_changes_nothing(spark):
    blocks, vectors = tables(spark)
    df = spark.createDataFrame([("https://a/1", None, "t", None, None, "body", T0)], schemas.SUBMISSION)
    ingest.ingest_records(df, blocks, vectors)
    once = blocks.read().collect(), vectors.read().collect()
    ingest.ingest_records(df, blocks, vectors)
    assert (blocks.read().collect(), vectors.read().collect()) == once


def test_transfer_only(spark):
    blocks, vectors = tables(spark)
    rows = spark.createDataFrame([("1", "u", "some text", "t", None, None, T0, T0, "{}"), ("2", "u", None, "t", None, None, T0, T0, "{}")], schemas.BLOCK)
    blocks.upsert(rows, B.replace_parts)
    ingest.transfer_vectors(blocks, vectors)
    assert tuples(vectors.read(), "id") == [("1",)] and vectors.metric == "cosine"


def test_hit_files(spark, tmp_path):
    hits = spark.createDataFrame([("1", 0.5, "t", "d", "u", "p")], "block_id string, score double, title string, description string, source_url string, text_preview string")
    write_hits(hits, str(tmp_path / "j"), "json")
    write_hits(hits.select("score", "title", "source_url", "text_preview"), str(tmp_path / "t"), "text")
    assert tuples(spark.read.json(str(tmp_path / "j")), *sorted(hits.columns)) == tuples(hits, *sorted(hits.columns))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert text == "Score: 0.500\nTitle: t\nURL: u\nPreview: p...\n\n"
