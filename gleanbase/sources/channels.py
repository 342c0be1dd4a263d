"""Channels: landed API pages of blocks, headers, flattening and channel aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.skew import spread_join

BLOCKS_PER_PAGE = 100  # fixed value: page size of the channel API


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Landed channel pages, one JSON object per page. Line-delimited files are split
    between tasks; ``multi_line`` takes one object (or array) per file."""
    return spark.read.schema(schemas.CHANNEL_PAGE).option("multiLine", multi_line).json(path)


def read_headers(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schemas.CHANNEL_HEADER).option("multiLine", multi_line).json(path)


def page_sizes(pages: DataFrame) -> DataFrame:
    """Rows per landed page; a page without contents has none."""
    size = F.coalesce(F.size(F.col("contents")), F.lit(0))
    return pages.select("channel", "page", F.greatest(size, F.lit(0)).cast("long").alias("n"))


def last_pages(sizes: DataFrame, per: int = BLOCKS_PER_PAGE) -> DataFrame:
    """The last page to keep of each channel: pages count up from 1 and end with the
    first that is not exactly ``per`` long, or before the first that is missing.

    Each page row meets its predecessor's row in one aggregate keyed by (channel, page),
    so the pages of a large channel spread over all tasks; only the minimum per channel,
    combined before its shuffle, is taken channel-wide.
    """
    here = sizes.select("channel", "page", "n", F.lit(0).alias("follows"))
    back = sizes.select("channel", (F.col("page") - 1).alias("page"), F.lit(None).cast("long").alias("n"),
                        F.lit(1).alias("follows"))
    seen = here.unionByName(back).groupBy("channel", "page").agg(
        F.max("n").alias("n"), F.max("follows").alias("follows"))
    # page 0 stands for the start: it has no rows of its own and must be followed by 1
    ends = F.when(F.col("n").isNotNull() & ((F.col("n") != per) | (F.col("follows") == 0)), F.col("page"))
    starts = F.max(F.when((F.col("page") == 0) & (F.col("follows") == 1), 1))
    return seen.groupBy("channel").agg(
        F.when(starts == 1, F.min(F.when(F.col("page") >= 1, ends))).otherwise(F.lit(0)).alias("last_page"))


def complete_prefix(rows: DataFrame, last: DataFrame, spread_by: str = "page") -> DataFrame:
    """Keep the rows of pages 1 to last_page; a channel may hold most of the rows."""
    kept = spread_join(rows, last, "channel", "inner", F.col(spread_by))
    return kept.filter((F.col("page") >= 1) & (F.col("page") <= F.col("last_page"))).drop("last_page")


def flatten(pages: DataFrame) -> DataFrame:
    """One row per block with its channel and arrival position; pages without contents
    give no row."""
    return pages.select("channel", "page", F.posexplode("contents").alias("pos", "block")).select(
        "channel", "page", "pos", "block.*")


def channel_blocks(pages: DataFrame, per: int = BLOCKS_PER_PAGE) -> DataFrame:
    """The source proper: the complete prefix of every channel, flattened."""
    return flatten(complete_prefix(pages, last_pages(page_sizes(pages), per)))


def with_headers(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Channel header fields on each page; the header's own contents give way to the
    paged list. ``channel`` of the pages is the slug."""
    heads = headers.drop("contents").withColumnRenamed("slug", "channel")
    return spread_join(pages, heads, "channel", "left", F.col("page"))


def union_blocks(*frames: DataFrame) -> DataFrame:
    """Channels one after another, duplicates kept; ``channel_ord`` keeps the order."""
    out = None
    for n, frame in enumerate(frames):
        part = frame.withColumn("channel_ord", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def in_order(rows: DataFrame, names: list[str], channel: str = "channel") -> DataFrame:
    """The rows of the named channels as ``union_blocks`` of one frame for each would give
    them, from one scan: ``channel_ord`` is the place of the name in the list (of its first
    mention). Rows of other channels, and of none, go."""
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col(channel)) if names else F.lit(0)
    return rows.filter(F.col(channel).isin(*names)).withColumn("channel_ord", (place - 1).cast("int"))


def channels_per_block(rows: DataFrame, id_col: str = "id", channel: str = "channel") -> DataFrame:
    """Sorted channel titles of each block. Pairs are made distinct first (combined
    before the shuffle), so an array holds no more than the number of channels."""
    pairs = rows.select(id_col, channel).distinct()
    return pairs.groupBy(id_col).agg(F.sort_array(F.collect_list(channel)).alias("channels"))


def channel_names(rows: DataFrame, channel: str = "channel") -> DataFrame:
    return rows.select(channel).distinct()
