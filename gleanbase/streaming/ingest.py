"""Incremental ingest: landed records through a micro-batch upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.embed import Encoder, HashEncoder
from ..plans.ingest import Counts, ingest_records
from ..session import written
from ..sources.tables import BucketTable, VectorTable


def landed_records(spark: SparkSession, path: str, schema: T.StructType = schemas.SUBMISSION,
                   fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Files of a landing folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def start_ingest(records: DataFrame, blocks: BucketTable, vectors: VectorTable | None, checkpoint: str,
                 rejects_path: str | None = None, make_encoder: Callable[[], Encoder] = HashEncoder,
                 on_counts: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Start the upsert of everything that has landed so far (availableNow); started again
    with the same checkpoint it takes up where it stopped.

    A batch that failed half-way is replayed under its number: the upserts give the same rows
    again, and rejects are overwritten batch by batch. ``on_counts`` is told the figures of
    each batch, by its number.
    """
    def take(batch: DataFrame, number: int) -> None:
        counts = Counts()
        rejects = ingest_records(batch, blocks, vectors, make_encoder, counts)
        if on_counts is not None:
            on_counts(number, counts.get())
        if rejects_path is not None:
            rejects.write.mode("overwrite").json(f"{rejects_path}/batch={number}")

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def start_upsert(rows: DataFrame, table: BucketTable, prepare: Callable[[DataFrame], DataFrame],
                 merge: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """The same loop for any keyed table: ``prepare`` makes one row per key of a batch."""
    def take(batch: DataFrame, number: int) -> None:
        # the upsert reads its batch more than once, the source should be read only once
        table.upsert(written(prepare(batch), "batch"), merge)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
