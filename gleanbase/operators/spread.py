"""Spreading small inputs before work that is heavy per row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def in_parts(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows: what a worker makes of them at once does
    not grow with the batches of the session."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scanned_bytes(df: DataFrame) -> int | None:
    """Estimated size of everything ``df`` reads, without running it; None if unknown."""
    if not hasattr(df, "_jdf"):  # a remote session has no plan to look at
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(n).stats().sizeInBytes())) for n in range(leaves.size()))


def small_enough(df: DataFrame, files: int = 32 << 20, rows: int = 128 << 20) -> bool:
    """Whether ``df`` may be broadcast: it reads no more than ``files`` bytes and Spark
    puts its own size at no more than ``rows`` bytes."""
    size = scanned_bytes(df)
    if size is None or size > files:
        return False
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= rows


FILL_BYTES = 256 << 20  # most that is moved to fill the cores, whatever their number


def fill_cores(df: DataFrame) -> DataFrame:
    """Repartition an input too small to give every core a split of its own; leave any
    other where it is, since its scan has tasks enough and a shuffle would only cost."""
    size = scanned_bytes(df)
    session = df.sparkSession
    if size is None:
        return df
    cores = session.sparkContext.defaultParallelism
    split = session._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < min(cores * split, FILL_BYTES) else df
