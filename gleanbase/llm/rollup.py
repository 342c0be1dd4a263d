"""Token counts as rollups kept by deltas.

A batch of changes becomes signed sums by source, language and tokenizer version, written as
one folder of the rollup named by the batch. Totals are the sums over all folders. To commit
a batch again replaces its folder by the same rows, so a replay, or a retry after a lost
job, counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("source", "lang", "tokenizer")
SCHEMA = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("n_docs", T.LongType()),
                       T.StructField("n_tokens", T.LongType())])


def inserts(counted: DataFrame) -> DataFrame:
    """Signed rows that add documents: columns of KEYS and n_tokens."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Signed rows that take documents back, with the counts they went in with."""
    return inserts(counted).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that replace counts: of another tokenizer version, source or language."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Additive totals at ``path``, a folder all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, signed: DataFrame) -> None:
        """Write the sums of a batch in the place of what an earlier commit of it wrote.

        ``batch`` is a name without slashes. Sums are combined before the shuffle, so a source
        with a large share of the rows costs no more than others. Null sources and languages
        are groups of their own; null counts add nothing.
        """
        if not batch or "/" in batch:
            raise ValueError(f"no name for a batch: {batch!r}")
        sums = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        sums.filter("n_docs != 0 OR n_tokens != 0").coalesce(8).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def totals(self) -> DataFrame:
        """Sums over all batches; groups that came to nothing are left out. No rows before the
        first commit. A batch that is taken back under two names is taken back twice."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 OR n_tokens != 0")
