"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001
HOT_ROWS = 100_000
SALT_ROWS = 1_000_000  # rows of a hot key for each salt
SALTS = 8              # and the fewest salts of a hot key


def _unused(name: str, *frames: DataFrame) -> str:
    """``name``, with lines before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """(key, n): keys that hold at least ``share`` of all rows (and at least ``rows`` rows),
    with their number of rows.

    There can be no more than ``1 / share`` of them, so the result may be broadcast
    whatever the size of ``df``. The count is combined before its shuffle.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(rows), F.ceil(F.lit(share) * counts.agg(F.sum("n")).scalar()))
    return counts.filter(F.col("n") >= least)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str, spread_by: Column, salts: int = 16) -> DataFrame:
    """Equi-join of many rows to a short table of keys (channels, sites, words): every
    left row takes one of ``salts`` places and the short side is repeated in each, so no
    key can fill a task and the left side need not be counted first. Where the short side
    is small enough to broadcast, Spark does that instead and the salt costs nothing."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    salt = _unused("_salt", left, right)
    lhs = left.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    rhs = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [key, salt], how).drop(salt)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_by: Column,
    *,
    hot: DataFrame | None = None,
    salts: int = SALTS,
    parts: int | None = None,
) -> DataFrame:
    """Equi-join whose hot left keys are spread over partitions: one for each SALT_ROWS of
    their rows, ``salts`` at least. Keys of less than the hot share stay whole; if one of them
    fills a partition beyond Spark's limit of skew, its skew join splits it.

    For a right side too large to repeat whole. Only the right rows of hot keys are repeated, once per salt; every other row takes
    part once. ``spread_by`` must be a deterministic column of the left side (an id, so
    that a retried task sends a row to the same place). ``how`` may be inner, left,
    left_semi or left_anti: a left row meets each matching right row exactly once.
    ``hot`` (key, and n if known) replaces the detection when the caller already has counts;
    it must be of bounded size. Null keys match nothing and are spread as well. ``parts`` is the
    number of partitions that both sides are dealt to where that should not be left to Spark.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if hot is None:
        hot = hot_keys(left, key)
    by_count = F.ceil(F.col("n") / F.lit(SALT_ROWS)).cast("int") if "n" in hot.columns else F.lit(salts)
    salt, mark = _unused("_salt", left, right), _unused("_hot", left, right)
    marked = F.broadcast(hot.select(key, F.greatest(F.lit(salts), by_count).alias(mark)))
    wide = F.coalesce(mark, F.when(F.col(key).isNull(), F.lit(salts)))
    lhs = (
        left.join(marked, key, "left")
        .withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread_by), wide), F.lit(0)).cast("int"))
        .drop(mark)
    )
    copies = F.when(F.col(mark).isNotNull(), F.sequence(F.lit(0), F.col(mark) - 1)).otherwise(F.array(F.lit(0)))
    rhs = right.join(marked, key, "left").withColumn(salt, F.explode(copies)).drop(mark)
    if parts is not None:
        lhs, rhs = lhs.repartition(parts, key, salt), rhs.repartition(parts, key, salt)
    return lhs.join(rhs, [key, salt], how).drop(salt)
