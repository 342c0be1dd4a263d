"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and gives a DataFrame; the
next one reads what it wrote. All but the last keep the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbase.llm import copies, decontaminate, language, lines, simhash
from gleanbase.llm.common import fresh, table, without
from gleanbase.llm.queries import packed
from gleanbase.session import written

MIN_SCORE = 0.5  # posterior of the language below which a text is in none of those known


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from those with a label: texts without a
    letter, or as likely as not in another language, go. Where no document has a label there
    is no language to be in, and all texts with a letter stay."""
    model = language.train(docs.filter(language.fold() != 0))
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found, score = fresh(docs, "_found", "_score")
    named = language.predict(docs, model, into=(found, score))
    return named.filter((F.col(found) != language.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of passages; those that were nothing else go."""
    had, lost = fresh(docs, "_had", "_lost")
    cut = lines.dedup_lines(docs, into=(had, lost))
    return cut.filter(~((F.col(lost) > 0) & (F.col("text") == ""))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of SimHash links, then of those left
    the one with the least id of each component of links between texts that share 0.8 of
    their five-word shingles, which differ in more bits than SimHash segments can index. Rows
    that repeat an id are one document; rows without an id cannot be told apart and stay."""
    found = simhash.near_duplicates(docs)
    same = written(found.filter("doc_id != component_id").select("doc_id"), "copies")
    near = written(copies.near_copies(without(docs, same)), "copies")
    return without(docs, same.unionByName(near))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no window of a benchmark item. A row is told by its id and text,
    so that neither rows without an id nor other texts under the same id are mistaken for it."""
    row, gone = fresh(docs, "_row", "_gone")
    marked = docs.withColumn(row, F.struct("doc_id", F.xxhash64("text").alias("text")))
    found = decontaminate.decontaminate(marked, table(spark, sf_dir, "benchmark"), key=row)
    hit = written(found.filter(F.size("spans") > 0).select(F.col(row).alias(gone)), "contaminated").distinct()
    # they may be as many as the rows, so they are never broadcast
    return marked.join(hit.hint("merge"), F.col(row).eqNullSafe(F.col(gone)), "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

# No stage can be written in SQL: they need a trained model, XXH64 and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
