"""Counts per stage and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def stage_counts(blocks: DataFrame) -> DataFrame:
    """One row of run figures from one pass over (id, source_url, crawled_text)."""
    url = F.col("source_url")
    has_url = F.coalesce(url, F.lit("")) != ""
    has_text = F.coalesce(F.col("crawled_text"), F.lit("")) != ""
    return blocks.agg(
        F.count("*").alias("blocks"),
        F.count_if(has_url).alias("with_url"),
        F.count_if(has_url & F.col("crawled_text").isNull()).alias("to_parse"),
        F.count_distinct(F.when(has_url & F.col("crawled_text").isNull(), url)).alias("urls_to_parse"),
        F.count_if(has_text).alias("points"),
    )


def quality_by_site(blocks: DataFrame) -> DataFrame:
    """Rows, rows without text and mean length of text per site."""
    text = F.col("crawled_text")
    return (
        blocks.groupBy(urls.site(F.coalesce(F.col("source_url"), F.lit(""))).alias("site"))
        .agg(
            F.count("*").alias("blocks"),
            F.count_if(text.isNull()).alias("without_text"),
            F.count_if(text == "").alias("empty_text"),
            F.round(F.avg(F.length(text)), 2).alias("mean_length"),
        )
    )


def missing_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """Ids of an earlier sync that a later one did not return."""
    return before.select("id").distinct().join(now.select("id").distinct(), "id", "left_anti")
