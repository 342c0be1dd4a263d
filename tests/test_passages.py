import random

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from gleanbase.operators.keywords import chunks
from gleanbase.operators.passages import passage_contexts, passages


def plain(hits, texts, width, step):
    """Chunks put together as ranges of words."""
    best = {}
    for q, d, n, s in hits:
        best[q, d, n] = max(s, best.get((q, d, n), s))
    out = []
    for q, d in sorted({key[:2] for key in best}):
        group = []
        for n in sorted(n for a, b, n in best if (a, b) == (q, d)):
            if group and n * step <= group[-1] * step + width:
                group.append(n)
                continue
            if group:
                out.append((q, d, group))
            group = [n]
        out.append((q, d, group))
    return sorted((q, d, g[0], g[-1], max(best[q, d, n] for n in g), " ".join(texts[d].split(" ")[g[0] * step:g[-1] * step + width]))
                  for q, d, g in out)


@pytest.mark.parametrize("width,step", [(12, 10), (10, 10), (10, 4), (7, 1)])
def test_words_of_overlaps_stand_once(spark, width, step):
    rng = random.Random(width * step)
    texts = {f"d{n}": " ".join(f"w{n}_{k}" for k in range(rng.choice([1, 9, 10, 11, 12, 22, 57, 120]))) for n in range(12)}
    blocks = spark.createDataFrame(list(texts.items()), "id string, crawled_text string")
    parts = chunks(blocks, width=width, step=step)
    places = [tuple(r) for r in parts.select("id", "chunk_no").collect()]
    hits = [(q, *rng.choice(places), rng.randrange(9) / 10) for q in range(6) for _ in range(25)]
    hits = [(q, d, n, s) for q, d, n, s in hits]
    df = spark.createDataFrame(hits, "query_id long, id string, chunk_no int, score double").repartition(3)
    got = tuples(passages(df, parts, width, step), "query_id", "id", "first_chunk", "last_chunk", "score", "passage")
    assert sorted(got) == plain(hits, texts, width, step) and len(got) > 20


def test_contexts_and_odd_rows(spark):
    blocks = spark.createDataFrame([("a", "one two three four five", "A", None), ("b", "x", None, "u")], "id string, crawled_text string, title string, source_url string")
    parts = chunks(blocks, width=2, step=1).withColumn("score", F.lit(9.0))
    hits = spark.createDataFrame([(1, "a", 0, 0.5), (1, "a", 1, 0.7), (1, "b", 0, 0.7), (1, "a", 3, 0.1), (2, "gone", 0, 1.0), (2, "a", 77, 1.0), (3, None, 0, 1.0)],
                                 "query_id long, id string, chunk_no int, score double")
    found = passages(hits, parts.drop("score"), 2, 1)
    assert tuples(found, "query_id", "id", "passage") == [(1, "a", "one two three four five"), (1, "b", "x")]
    text = passage_contexts(found, blocks, 2).collect()
    assert [tuple(r) for r in text] == [(1, "Document 1:\nTitle: A\nURL: None\nContent: one two three four five\n\n\nDocument 2:\nTitle: None\nURL: u\nContent: x\n")]
    assert passages(hits.filter("false"), parts, 2, 1).count() == 0
