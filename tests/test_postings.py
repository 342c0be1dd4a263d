import random
from collections import Counter
from decimal import Decimal

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from gleanbase.operators import postings as P


def made(rng, docs=400, words=60):
    """Rare words are heavy, common ones light, as in a keyword index."""
    out = []
    for w in range(words):
        share = 1 / (1 + w)
        out += [(f"d{d:04d}", f"w{w}", round(rng.uniform(0.2, 1) * (1 + w) ** 0.5, 2)) for d in range(docs) if rng.random() < share]
    return out


def brute(index, questions, k):
    asked = {}
    for q, text in questions:
        asked.setdefault(q, set()).update((text or "").lower().split())
    out = []
    for q, words in asked.items():
        sums = Counter()
        for d, w, x in index:
            if w in words:
                sums[d] += Decimal(str(x))
        out += [(q, n + 1, d, float(s)) for n, (s, d) in enumerate(sorted((-s, d) for d, s in sums.items())[:k])]
    return sorted(((q, r, d, -s) for q, r, d, s in out), key=repr)


def frames(spark, index, questions):
    return (spark.createDataFrame(index, "id string, word string, weight double").repartition(4),
            spark.createDataFrame(questions, "query_id string, question string"))


@pytest.mark.parametrize("k,heads", [(1, 2), (5, 8), (500, 4)])
def test_equals_scoring_everything(spark, k, heads):
    rng = random.Random(k)
    index = made(rng)
    questions = [(f"q{n}", " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 9)))) for n in range(25)]
    rows, asked = frames(spark, index, questions)
    got = P.search_words(asked, P.build_postings(rows, heads), k)
    assert tuples(got, "query_id", "rank", "id", "score") == brute(index, questions, k)


def test_postings_below_the_bound_are_not_scored(spark):
    rng = random.Random(9)
    index = made(rng, docs=2000)
    questions = [("q", "w0 w1 w2 w55 w58")]
    rows, asked = frames(spark, index, questions)
    stored = P.build_postings(rows)
    plan = P.plan_words(asked, stored, 3)
    by_word = {r.word: r for r in plan.collect()}
    assert not by_word["w0"].essential and by_word["w58"].essential
    of_words = stored.rows.join(asked.select(F.explode(F.split("question", " ")).alias("word")), "word").count()
    live = P.live_postings(plan, stored)
    assert 0 < live.count() < of_words / 10
    assert tuples(P.search_words(asked, stored, 3), "query_id", "rank", "id", "score") == brute(index, questions, 3)


def test_odd_rows(spark):
    index = [("a", "x", 1.0), ("b", "x", 1.0), ("a", "x", 0.5), (None, "x", 9.0), ("c", None, 9.0), ("c", "x", None), ("d", "x", -1.0), ("c", "y", 0.0)]
    questions = [("1", "x X"), ("2", "y"), ("3", ""), ("4", None), ("5", "unknown"), ("6", "x"), ("6", "y"), (None, "x")]
    rows, asked = frames(spark, index, questions)
    stored = P.build_postings(rows.withColumns({"n": F.lit(1), "bound": F.lit(2)}))
    got = P.search_words(asked.withColumns({"rank": F.lit(1), "word": F.lit("w")}), stored, 2)
    assert tuples(got, "query_id", "rank", "id", "score") == [
        ("1", 1, "a", 1.0), ("1", 2, "b", 1.0), ("2", 1, "c", 0.0), ("6", 1, "a", 1.0), ("6", 2, "b", 1.0)]
    none = P.build_postings(rows.filter("false"))
    assert P.search_words(asked, none, 2).count() == 0
    assert P.search_words(asked.filter("false"), stored, 2).count() == 0


def test_short_blocks_are_ruled_out_by_all_their_weights(spark):
    """Every word is heavy in the long blocks, so no word alone is too light: the blocks are."""
    rng = random.Random(3)
    index = [(f"long{d}", f"w{w}", round(rng.uniform(5, 9), 2)) for d in range(6) for w in range(10)]
    index += [(f"s{d:04d}", f"w{w}", round(rng.uniform(0.2, 1), 2)) for d in range(1000) for w in rng.sample(range(10), 3)]
    questions = [("q", " ".join(f"w{w}" for w in range(10)))]
    rows, asked = frames(spark, index, questions)
    stored = P.build_postings(rows)
    assert 0 < P.live_postings(P.plan_words(asked, stored, 5), stored).count() <= 60
    assert tuples(P.search_words(asked, stored, 5), "query_id", "rank", "id", "score") == brute(index, questions, 5)


def test_many_pairs_in_small_files_are_not_broadcast(spark):
    """A million pairs of few names take some kilobytes of files and a hundred megabytes of memory."""
    index = [(f"d{n}", f"w{n % 3}", 1.0) for n in range(9)]
    rows, _ = frames(spark, index, [])
    stored = P.build_postings(rows)
    pairs = spark.range(1_000_000).select(F.format_string("q%d", F.col("id") % 5).alias("query_id"), F.format_string("d%d", F.col("id") % 9).alias("id"), F.format_string("w%d", F.col("id") % 3).alias("word"))
    found = P._looked_up(pairs, stored)
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    assert found.count() == 1_000_000
    assert "BroadcastHashJoin" in P._looked_up(pairs.limit(20), stored)._jdf.queryExecution().executedPlan().toString()


def test_words_that_bring_most_are_looked_up_first(spark):
    """The lesser words of most blocks bring far less than their bounds: few blocks are left for the last of them."""
    rng = random.Random(4)
    index = [(f"d{d:04d}", f"w{w}", round(rng.uniform(0.1, 0.4) if rng.random() < 0.99 else 2.0 + w / 10, 2)) for d in range(1500) for w in range(12)]
    index += [(f"d{d:04d}", "top", round(rng.uniform(8, 9), 2)) for d in range(0, 1500, 2)]
    index += [(f"d{d:04d}", f"not asked {n}", 9.0) for d in range(0, 1500, 2) for n in range(5)]
    index += [(f"long{d}", w, 6.0 if w == "top" else 3.3) for d in range(5) for w in ["top", *(f"w{n}" for n in range(12))]]
    questions = [("q", "top " + " ".join(f"w{w}" for w in range(12)))]
    rows, asked = frames(spark, index, questions)
    stored = P.build_postings(rows)
    plan = P.plan_words(asked, stored, 5)
    lesser = P.lesser_words(plan)
    assert lesser.count() > P.FIRST
    some = P.live_postings(plan, stored).groupBy("query_id", "id").agg(F.sum("weight").alias("part"))
    may = P.still_may(some, lesser, plan, 0)
    left = P.still_may(P._with_words(may, lesser.filter(F.col("place") <= P.FIRST), stored), lesser, plan, P.FIRST)
    assert 5 <= left.count() < may.count() / 2
    assert tuples(P.search_words(asked, stored, 5), "query_id", "rank", "id", "score") == brute(index, questions, 5)
