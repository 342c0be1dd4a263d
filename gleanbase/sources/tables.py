"""Keyed tables as parquet files partitioned by buckets of their key.

An upsert rewrites the buckets that its batch touches with Spark's own writer (dynamic
partition overwrite): new files are written beside the table and moved in when the job has
succeeded, so a job that fails leaves the table as it was. A driver that dies during the
moves can lose the older rows of a bucket. Upserts are idempotent: a batch that comes again
gives the same rows. One writer per table at a time; a DataFrame read before an upsert must
not be used after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.spread import small_enough


class BucketTable:
    """The partition column's name holds the number of buckets, so a table that is opened
    again keeps the number it was made with."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        stored = self._stored()
        made_with = [c.removeprefix("bucket_of_") for c in stored.columns if c.startswith("bucket_of_")] if stored else []
        self.buckets = int(made_with[0]) if made_with else buckets
        self.bucket = f"bucket_of_{self.buckets}"

    def _stored(self, schema: T.StructType | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(self.path)
        except AnalysisException:  # nothing has been stored yet
            return None

    def _whole(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(self.bucket, T.IntegerType())])
        stored = self._stored(schema)
        return self.spark.createDataFrame([], schema) if stored is None else stored

    def bucket_number(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._whole().drop(self.bucket)

    def near(self, keys: DataFrame) -> DataFrame:
        """The buckets that can hold the given keys; the others are not read."""
        # at most one row per bucket comes back
        touched = [r[0] for r in keys.select(self.bucket_number(F.col(self.key))).distinct().collect()]
        return self._whole().filter(F.col(self.bucket).isin(touched)).drop(self.bucket)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys."""
        return self.near(keys).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> None:
        """Replace the touched buckets by ``merge(stored, batch)``, which gives the stored
        rows brought up to date and the new rows. ``batch`` is read more than once."""
        kept, added = merge(self.near(batch), batch)
        kept, added = self._placed(kept), self._placed(added)
        # A small batch is broadcast: stored rows are then written from the tasks that read
        # their files and only new rows are brought together by bucket. A larger one shuffles
        # the stored rows anyway, by key, and all rows are brought together.
        together = kept.unionByName(added.hint("rebalance", self.bucket)) if small_enough(batch) else \
            kept.unionByName(added).hint("rebalance", self.bucket)
        together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            self.bucket).parquet(self.path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        return rows.select(*names, self.bucket_number(F.col(self.key)).alias(self.bucket))


class VectorTable(BucketTable):
    """A vector collection of one dimension. 384 dimensions by default, cosine
    metric."""

    metric = "cosine"

    def __init__(self, spark: SparkSession, path: str, dim: int = 384, buckets: int = 64):
        super().__init__(spark, path, schemas.VECTOR_POINT, "id", buckets)
        self.dim = dim
        stored = self.read().select(F.size("embedding")).first()
        if stored and stored[0] != dim:
            raise ValueError(f"the collection has {stored[0]} dimensions, not {dim}")


def block_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, path, schemas.BLOCK, "id", buckets)


def vector_table(spark: SparkSession, path: str, dim: int = 384, buckets: int = 64) -> VectorTable:
    return VectorTable(spark, path, dim, buckets)
