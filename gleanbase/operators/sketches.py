"""Figures of any span of syncs without a second look at their rows: sketches that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 12     # 2^12 registers of a sketch of distinct ids: 4 kB at most,
ID_ERROR = 0.05   # three standard errors of its estimate
RANKS = 400       # parameter of a sketch of quantiles, some kB for any number of rows:
RANK_ERROR = 0.01  # a quantile is a value whose true rank is this close, as a share of the rows


def sketch(rows: DataFrame, by: list[str], id_col: str, size: str) -> DataFrame:
    """A row for each value of ``by`` (a sync, a channel): the number of rows, a sketch of
    their distinct ids and one of the quantiles of ``size``, a whole number. Both are combined
    in each task before the shuffle, so a sync of any size sends a few kB per task. Null ids
    and sizes count as rows only."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(F.col(id_col).cast("string"), F.lit(LOG_SIZE)).alias("ids"),
        F.kll_sketch_agg_bigint(F.col(size).cast("long"), F.lit(RANKS)).alias("quantiles"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the same kind for fewer columns, or for a filtered span of syncs."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"))


def report(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """(columns of the sketches, rows, distinct_ids, sizes): the estimated number of distinct ids
    and the sizes at the ``shares`` of the rows; null sizes where there are none."""
    by = [c for c in sketches.columns if c not in ("rows", "ids", "quantiles")]
    known = F.kll_sketch_get_n_bigint("quantiles") > 0
    at = F.array(*(F.kll_sketch_get_quantile_bigint("quantiles", F.lit(float(x))) for x in shares))
    return sketches.select(*by, "rows", F.hll_sketch_estimate("ids").alias("distinct_ids"), F.when(known, at).alias("sizes"))
