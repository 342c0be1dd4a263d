"""Points stored in ranges of their id, so that a page of a scroll reads its own files only.

``write_ranges`` deals the rows over files by ranges of the key, each file in order, and
then puts a small table beside them with the least and greatest key of every file. A page
asks that table for the few files that can hold its rows and opens no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import scroll

ROWS_PER_FILE = 1_000_000


def write_ranges(df: DataFrame, path: str, key: str = "id", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store ``df`` at ``path``, which must not exist. ``df`` is read three times (its number
    of rows, a sample of its keys, the rows), so it should be a stored table.

    A row without a key stands in no range and is left out. A key of very many rows is cut
    into several files. An empty table gives an empty table. The bounds are written last:
    a folder without them was not finished.
    """
    path = path.rstrip("/")
    points = df.filter(F.col(key).isNotNull())
    parts = max(1, -(-points.count() // rows_per_file))
    points.repartitionByRange(parts, key).sortWithinPartitions(key).write.option(
        "maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n")).write.parquet(f"{path}/bounds")


def scroll_ranges(spark: SparkSession, path: str, offset=None, limit: int = 10, key: str = "id") -> DataFrame:
    """``scroll`` over a table of ``write_ranges``: the same rows and next_offset, from the
    files of the page alone. At most limit + 1 rows of the bounds come to the driver, since
    each of their files holds a row of the page or of what follows it."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    path = path.rstrip("/")
    bounds = spark.read.parquet(f"{path}/bounds")
    if offset is not None:
        bounds = bounds.filter(F.col("most") >= F.lit(offset))
    inside = F.lit(True) if offset is None else F.col("least") >= F.lit(offset)
    near = bounds.select("file", "least", "most", F.when(inside, F.col("n")).otherwise(1).alias("n")).orderBy(
        "least", "most", "file").limit(limit + 1).collect()
    files, sure = [], 0
    for row in near:
        if sure > limit:
            break
        files.append(f"{path}/rows/{row['file']}")
        sure += row["n"]  # rows that certainly belong to the page or follow it
    page = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return scroll(page, offset, limit, key)
