"""Passages for retrieval: chunks that were hit, put together where they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hits as h
from .rows import ranked
from .skew import salted_join


def passages(hits: DataFrame, chunks: DataFrame, width: int = 120, step: int = 100) -> DataFrame:
    """(query_id, id, first_chunk, last_chunk, score, passage) from the hits (query_id, id, chunk_no,
    score) of chunks (id, chunk_no, chunk) cut with ``width`` and ``step``.

    Hits of one text that overlap or touch are one passage, whose text has the words of the
    overlaps once; its score is that of its best chunk. A hit that is repeated counts once,
    with its best score, and one without a chunk is left out. A query's chunks of one text are
    no more than its hits.
    """
    reach = width // step  # chunks so far apart still touch
    once = hits.groupBy("query_id", "id", "chunk_no").agg(F.max("score").alias("score"))
    # a text that answers many queries is in many hits
    texts = salted_join(once.withColumn("at", F.struct("id", "chunk_no")), chunks.select(
        F.struct("id", "chunk_no").alias("at"), "chunk"), "at", "inner", F.col("query_id")).drop("at")
    own = Window.partitionBy("query_id", "id").orderBy("chunk_no")
    gap = F.col("chunk_no") - F.lag("chunk_no").over(own)
    marked = texts.withColumn("gap", gap).withColumn("island", F.sum(F.when(F.col("gap") <= reach, 0).otherwise(1)).over(own))
    # of each chunk after the first of an island the words that the one before has not
    overlap = F.greatest(F.lit(width) - F.lit(step) * F.col("gap"), F.lit(0))
    fresh = F.when(F.col("gap") <= reach, F.array_join(F.expr("slice(split(chunk, ' ', -1), cut + 1, greatest(size(split(chunk, ' ', -1)) - cut, 0))"), " "))
    parts = marked.withColumn("cut", F.coalesce(overlap, F.lit(0)).cast("int")).withColumn("part", F.coalesce(fresh, F.col("chunk")))
    # the last chunk of a text may have no words of its own
    empty = (F.col("cut") > 0) & (F.size(F.split("chunk", " ", -1)) <= F.col("cut")) & (F.col("gap") <= reach)
    ordered = F.sort_array(F.collect_list(F.when(~F.coalesce(empty, F.lit(False)), F.struct("chunk_no", "part"))))
    return parts.groupBy("query_id", "id", "island").agg(
        F.min("chunk_no").alias("first_chunk"), F.max("chunk_no").alias("last_chunk"), F.max("score").alias("score"),
        F.array_join(F.transform(ordered, lambda p: p["part"]), " ").alias("passage")).drop("island")


def passage_contexts(found: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, context): the best k passages of each query as one text, in the form of a
    context, with title and address of their blocks (id, title, source_url); ties by id and chunk."""
    best = ranked(found, ["query_id"], [F.col("score").desc(), F.col("id"), F.col("first_chunk")], k)
    named = salted_join(best, blocks.select("id", "title", "source_url"), "id", "left", F.col("query_id"))
    entry = h.context_entry(F.col("rank"), F.col("title"), F.col("source_url"), F.col("passage"))
    return named.select("query_id", "rank", entry.alias("entry")).groupBy("query_id").agg(
        F.expr(r"listagg(entry, '\n\n') within group (order by rank)").alias("context"))
