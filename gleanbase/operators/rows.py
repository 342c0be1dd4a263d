"""Deduplication, ranks, samples and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1 within each key. With ``k`` only the first k rows stay; Spark then
    limits every group before the shuffle too (WindowGroupLimit), so a key holding a
    third of the rows sends at most k rows per task."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def last_per_key(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The row that arrived last for each key; ``arrival`` must order the rows fully."""
    order = [F.col(c).desc() for c in arrival]
    return ranked(df, keys, order, 1, "_last").drop("_last")


def random_sample(df: DataFrame, n: int = 20, seed: int = 0, id_col: str = "id") -> DataFrame:
    """n rows in a seeded random order, the same on every run."""
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.orderBy(lot, F.col(id_col)).limit(n)


def scroll(df: DataFrame, offset=None, limit: int = 10, id_col: str = "id") -> DataFrame:
    """A page of points in id order from ``offset`` (an id, inclusive), each row with the
    id where the next page begins (null at the end). The filter reaches the scan and
    only limit + 1 rows per task are kept."""
    if offset is not None:
        df = df.filter(F.col(id_col) >= F.lit(offset))
    head = df.orderBy(id_col).limit(limit + 1)
    # at most limit + 1 rows are left here, so one ordered window is enough
    whole = Window.orderBy(id_col)
    return (
        head.withColumn("_n", F.row_number().over(whole))
        .withColumn("next_offset", F.max(F.when(F.col("_n") > limit, F.col(id_col))).over(Window.partitionBy()))
        .filter(F.col("_n") <= limit)
        .drop("_n")
    )
