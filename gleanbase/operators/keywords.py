"""Text chunks and the keyword index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written
from .rows import ranked
from .skew import spread_join

PART_ROWS = 2000  # texts of a task that counts their words,
LEAST_PARTS = 8   # and the fewest of these tasks


def chunks(df: DataFrame, text: str = "crawled_text", width: int = 120, step: int = 100) -> DataFrame:
    """Overlapping runs of ``width`` blank-separated words, one every ``step`` words; the
    last one may be shorter. Covers the whole text."""
    if not 0 < step <= width:
        raise ValueError("step must be between 1 and width")
    parts = F.col("_words")
    last = F.greatest(F.ceil((F.size(parts) - width) / F.lit(step)), F.lit(0)).cast("int")
    keep = [c for c in df.columns if c != text]
    return (
        df.filter(F.coalesce(F.col(text), F.lit("")) != "")
        .withColumn("_words", F.split(F.col(text), " ", -1))
        # the pieces are cut before the rows multiply, so no row carries the whole text along
        .select(*keep, F.posexplode(F.transform(
            F.sequence(F.lit(0), last),
            lambda n: F.concat_ws(" ", F.slice(parts, n * step + 1, F.lit(width))),
        )).alias("chunk_no", "chunk"))
    )


def word_counts(df: DataFrame, text: str = "crawled_text", min_length: int = 1, parts: int | None = None) -> DataFrame:
    """(id, word, n). The texts are laid out by id first: a text is smaller than the list
    of its counted words, and the counting then needs no shuffle of its own. The counts of a task
    take many times the memory of its texts: ``parts`` is the number of tasks, that of the
    session by default."""
    laid = df.select("id", text)
    return (
        (laid.repartition("id") if parts is None else laid.repartition(parts, "id")).select("id", F.explode(tx.words(F.col(text), min_length)).alias("word"))
        .groupBy("id", "word").agg(F.count("*").alias("n"))
    )


def keyword_index(df: DataFrame, text: str = "crawled_text", min_length: int = 1,
                  share: float = 1e-5, rows: int = 100) -> DataFrame:
    """All words of each block with their tf-idf: (id, word, weight). Words that make up at
    least ``share`` of all counts (and ``rows`` of them) would make hot join keys and are most of the
    rows: they are at most ``1 / share`` words, known from the counts themselves, so their
    numbers of blocks go to all tasks and only the counts of other words are shuffled."""
    total = df.select("id").agg(F.count("*")).first()[0]
    # so that no task gets more of the input as it grows
    parts = max(LEAST_PARTS, -(-total // PART_ROWS))
    # read several times below; the texts are split into words once
    counted = written(word_counts(df, text, min_length, parts), "words")
    spread = written(counted.groupBy("word").agg(F.count("*").alias("df")), "spread")
    least = max(rows, share * counted.count())
    common = F.broadcast(spread.filter(F.col("df") >= least))
    # none of the other words is hot
    rare = counted.join(common.select("word"), "word", "left_anti").repartition(parts, "word").join(
        spread.filter(F.col("df") < least).repartition(parts, "word"), "word")
    joined = counted.join(common, "word").unionByName(rare)
    weight = F.round(F.col("n") * F.log(F.lit(total) / F.col("df")), 4) + F.lit(0.0)
    return joined.select("id", "word", weight.alias("weight"))


def top_words(index: DataFrame, top: int = 10) -> DataFrame:
    """The heaviest words of each block, for display: (id, word, weight, rank)."""
    return ranked(index, ["id"], [F.col("weight").desc(), F.col("word")], top)


def keyword_cloud(index: DataFrame) -> DataFrame:
    """Weight of each keyword over all blocks. The way back to the blocks is the index
    itself (one row per word and block), so no list grows with a common word. Weights have
    four decimals and are added as decimals, in any order to the same sum."""
    return index.groupBy("word").agg(
        F.count("*").alias("blocks"), F.round(F.sum(F.col("weight").cast("decimal(18,4)")), 2).cast("double").alias("weight"))


def keyword_lookup(index: DataFrame, blocks: DataFrame, wanted: DataFrame | list[str]) -> DataFrame:
    """Blocks behind the wanted words. Of ``index`` only the rows of wanted words are shuffled if these are few
    enough to broadcast; else its rows are dealt by word and salt, so it need not be counted first."""
    if isinstance(wanted, DataFrame):
        hits = spread_join(index, wanted.select("word").distinct(), "word", "left_semi", F.col("id"))
    else:
        hits = index.filter(F.col("word").isin(*wanted))
    return hits.join(blocks, "id")
