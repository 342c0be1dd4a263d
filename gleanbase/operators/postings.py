"""Ranked search for several words: postings of each word, and upper bounds.

The score of a block is the sum of its weights of the words asked for. The heaviest postings
of each word give sums; the blocks with the best of these are scored in full, and the k-th of
their scores is a threshold. Words whose
greatest weights together stay below it cannot bring a block up to it alone, so their postings
(those of common words, the long lists) are only looked up for blocks that may still reach it;
and of the others a posting counts only if it reaches the threshold with the greatest weights
of all other words. A block also stays below it if all its weights together do, or as many times its greatest
weight as there are words asked for: most blocks are short and are ruled out so. Of the words looked up, the few that may
bring the most come first, and the others are looked up for blocks that may still reach the threshold with what these
brought. The answer is that of scoring everything; weights are decimals, so sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import scratch_path, written
from .rows import ranked
from .skew import salted_join, spread_join

HEADS = 64  # heaviest postings of each word that are summed for a threshold
TRIED = 4   # blocks scored in full for it, for each one wanted
FIRST = 4   # words of a question that are looked up before the others
PAIRS_BYTES = 32 << 20  # most that pairs to look up may take in memory where they are broadcast,
PAIR_BYTES = 96         # of which each takes so much beside its texts


@dataclass
class Postings:
    """``rows``: (word, id, weight, whole, most), the last two the sum and the greatest of the block's weights; ``bounds``: (word, bound, n), the greatest weight and the number
    of postings; ``heads``: how many of the first postings of a word are summed for a threshold."""

    rows: DataFrame
    bounds: DataFrame
    heads: int


def build_postings(index: DataFrame, heads: int = HEADS, path: str | None = None) -> Postings:
    """Store a keyword index (id, word, weight). Rows are dealt by a hash of their id, so the
    postings of a common word lie in all files; weights below zero and null
    words or ids are left out, and of rows that repeat a word and id the heaviest counts."""
    spark, path = index.sparkSession, path or scratch_path(index.sparkSession, "postings")
    laid = index.filter("id IS NOT NULL AND word IS NOT NULL AND weight >= 0").select("word", "id", "weight").repartition("id")
    fit = laid.groupBy("word", "id").agg(F.max("weight").cast("decimal(18,4)").alias("weight"))
    own = Window.partitionBy("id")
    fit.withColumns({"whole": F.sum("weight").over(own), "most": F.max("weight").over(own)}).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy("word").agg(F.max("weight").alias("bound"), F.count("*").alias("n")).write.parquet(f"{path}/bounds")
    return Postings(rows, spark.read.parquet(f"{path}/bounds"), heads)


def _few(pairs: DataFrame) -> bool:
    """Whether the pairs may be broadcast, by their rows: names repeat, so their files may be a
    hundredth of what they take in memory."""
    texts = sum((F.octet_length(F.col(c).cast("string")) for c in ("query_id", "id", "word")), F.lit(PAIR_BYTES))
    return (pairs.agg(F.sum(texts)).first()[0] or 0) <= PAIRS_BYTES


def _looked_up(pairs: DataFrame, postings: Postings) -> DataFrame:
    """(query_id, id, weight): the postings of the pairs (query_id, id, word) that have one. Pairs may be
    as many as the postings: they are broadcast only where they are found few; else only the postings of
    their words are dealt out to meet them."""
    pairs = written(pairs, "pairs")
    rows = postings.rows.select("word", "id", "weight")
    if _few(pairs):
        met = rows.join(F.broadcast(pairs), ["word", "id"])
    else:
        own = written(pairs.select("word").distinct(), "words")
        # Spark would take the small files of the pairs for a small table
        met = spread_join(rows, own, "word", "left_semi", F.col("id")).join(pairs.hint("merge"), ["word", "id"])
    return met.select("query_id", "id", "weight")


def plan_words(questions: DataFrame, postings: Postings, k: int, text: str = "question") -> DataFrame:
    """(query_id, word, bound, asked, threshold, rest, essential) of the words asked for that have
    postings: ``asked`` is the number of words of the question, ``rest`` is what the other words bring at most, and a word is not essential if it and all
    words of lesser bounds together stay below the threshold."""
    asked = questions.filter("query_id IS NOT NULL").select("query_id", F.explode(tx.words(F.col(text))).alias("word")).distinct().join(postings.bounds, "word")
    asked = written(asked.select("query_id", "word", "bound"), "asked")
    # few words are broadcast; with hot words counted, Spark takes them for many and shuffles all postings
    wanted = spread_join(postings.rows.select("word", "id", "weight"), asked.select("word").distinct(), "word", "left_semi", F.col("id"))
    heads = ranked(wanted, ["word"], [F.col("weight").desc(), F.col("id")], postings.heads, "_n").drop("_n")
    sums = salted_join(asked, heads, "word", "inner", F.col("query_id")).groupBy("query_id", "id").agg(
        F.sum("weight").alias("score"))
    tried = ranked(sums, ["query_id"], [F.col("score").desc(), F.col("id")], TRIED * k).select("query_id", "id")
    scores = _looked_up(tried.join(asked.select("query_id", "word"), "query_id"), postings).groupBy("query_id", "id").agg(
        F.sum("weight").alias("score"))
    least = ranked(scores, ["query_id"], [F.col("score").desc(), F.col("id")], k).filter(F.col("rank") == k).select(
        "query_id", F.col("score").alias("threshold"))
    own = Window.partitionBy("query_id")  # the words of one question
    upto = own.orderBy("bound", "word")
    known = asked.join(least, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("decimal(28,4)")))
    return known.select("query_id", "word", "bound", F.count("*").over(own).alias("asked"), "threshold", (F.sum("bound").over(own) - F.col("bound")).alias("rest"),
                        (F.sum("bound").over(upto) >= F.col("threshold")).alias("essential"))


def live_postings(plan: DataFrame, postings: Postings) -> DataFrame:
    """(query_id, id, word, weight): the postings of essential words that are scored."""
    met = salted_join(plan.filter("essential"), postings.rows, "word", "inner", F.col("query_id"))
    may = met.filter("weight + rest >= threshold AND whole >= threshold AND most * asked >= threshold")
    return may.select("query_id", "id", "word", "weight", "threshold")


def lesser_words(plan: DataFrame) -> DataFrame:
    """(query_id, word, bound, place): the words that are looked up, from the one that may bring the most."""
    return ranked(plan.filter("NOT essential").select("query_id", "word", "bound"), ["query_id"], [F.col("bound").desc(), F.col("word")], name="place")


def still_may(parts: DataFrame, lesser: DataFrame, plan: DataFrame, looked_up: int) -> DataFrame:
    """The (query_id, id, part) that reach the threshold of the question if each of its lesser words
    but the first ``looked_up`` brings its bound."""
    left = lesser.filter(F.col("place") > looked_up).groupBy("query_id").agg(F.sum("bound").alias("left"))
    need = plan.select("query_id", "threshold").distinct().join(left, "query_id", "left").select(
        "query_id", (F.col("threshold") - F.coalesce("left", F.lit(0).cast("decimal(18,4)"))).alias("need"))
    return parts.join(need, "query_id").filter("part >= need").select("query_id", "id", "part")


def _with_words(parts: DataFrame, words: DataFrame, postings: Postings) -> DataFrame:
    """(query_id, id, part): the parts with what the words (query_id, word) bring."""
    pairs = parts.select("query_id", "id").join(words.select("query_id", "word"), "query_id")
    more = _looked_up(pairs, postings).withColumnRenamed("weight", "part")
    return parts.unionByName(more).groupBy("query_id", "id").agg(F.sum("part").alias("part"))


def search_words(questions: DataFrame, postings: Postings, k: int = 10, text: str = "question") -> DataFrame:
    """(query_id, rank, id, score): the k blocks with the greatest sums of weights of the words
    of each question, ties by id. Each word of a question counts once. Questions without a known word,
    null and empty ones and those without an id have no hits; rows that repeat a query_id are one question with the
    words of all."""
    plan = written(plan_words(questions, postings, k, text), "plan")
    some = live_postings(plan, postings).groupBy("query_id", "id").agg(F.sum("weight").alias("part"))
    lesser = lesser_words(plan)
    may = written(still_may(some, lesser, plan, 0), "candidates")
    may = written(still_may(_with_words(may, lesser.filter(F.col("place") <= FIRST), postings), lesser, plan, FIRST), "candidates")
    scores = _with_words(may, lesser.filter(F.col("place") > FIRST), postings)
    out = ranked(scores, ["query_id"], [F.col("part").desc(), F.col("id")], k)
    return out.select("query_id", "rank", "id", F.col("part").cast("double").alias("score"))
