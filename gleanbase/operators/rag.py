"""Retrieval contexts and prompts for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hits as h

TEMPLATE = (
    "Below are passages from the archive, each with its title and address.\n\n"
    "{context}\n\n"
    "Using only these passages, answer the question that follows. Quote where it helps, name the\n"
    "address of every passage you rely on, and say so if the passages do not hold the answer.\n\n"
    "Question: {question}\n"
    "Answer:"
)


def contexts(hits: DataFrame) -> DataFrame:
    """One context text per query from its ranked hits; a group has k rows at most."""
    entry = h.context_entry(F.col("rank"), F.col("title"), F.col("source_url"), F.col("text_preview"))
    return (
        hits.select("query_id", "rank", entry.alias("entry"))
        .groupBy("query_id")
        .agg(F.expr(r"listagg(entry, '\n\n') within group (order by rank)").alias("context"))
    )


def prompts(questions: DataFrame, found: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(query_id, context, prompt) for every question, also one without any hit."""
    before, rest = template.split("{context}")
    between, after = rest.split("{question}")
    joined = questions.select("query_id", "question").join(found, "query_id", "left")
    context = F.coalesce(F.col("context"), F.lit(""))
    return joined.select(
        "query_id", context.alias("context"),
        F.concat(F.lit(before), context, F.lit(between), F.coalesce("question", F.lit("")), F.lit(after)).alias("prompt"),
    )
