"""The ingest jobs: channels or submitted records to the block and vector tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.blocks import block_rows, has_text, merge_parts, payload, submitted_blocks
from ..operators.embed import DIM, Encoder, HashEncoder, embed
from ..operators.parse import parse_pages
from ..operators.rows import last_per_key
from ..operators.vectors import upsert_points
from ..session import written
from ..sources.channels import union_blocks
from ..sources.tables import BucketTable, VectorTable

ARRIVAL = ["channel_ord", "page", "pos"]


class Counts:
    """Figures of a run, taken while its own jobs run: no row is read for them alone. A stage
    that did not run, for it had nothing to read, counts 0."""

    def __init__(self):
        self._seen: list[tuple[Observation, list[str]]] = []

    def of(self, df: DataFrame, **figures: Column) -> DataFrame:
        watch = Observation()
        self._seen.append((watch, list(figures)))
        return df.observe(watch, *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in figures.items()))

    def get(self) -> dict[str, int]:
        """After the run: {figure: number}."""
        return {n: watch.get.get(n, 0) for watch, names in self._seen for n in names}


def _together(channels: DataFrame | list[DataFrame]) -> DataFrame:
    """Frames one after another, or a frame that has its ``channel_ord`` (see ``in_order``)."""
    return channels if isinstance(channels, DataFrame) else union_blocks(*channels)


def points_of(blocks: DataFrame, make_encoder: Callable[[], Encoder] = HashEncoder, dim: int = DIM) -> DataFrame:
    """Vector points of the blocks that have text."""
    rows = has_text(blocks)
    return embed(rows.select("id", "crawled_text", payload(rows).alias("payload")), "crawled_text",
                 make_encoder, dim).select("id", "embedding", "payload")


def store_vectors(blocks: DataFrame, vectors: VectorTable, make_encoder: Callable[[], Encoder] = HashEncoder) -> None:
    """Embed and upsert. The upsert of points reads its batch once, so the encoder does not run again."""
    upsert_points(vectors, points_of(blocks, make_encoder, vectors.dim))


def transfer_vectors(blocks: BucketTable, vectors: VectorTable,
                     make_encoder: Callable[[], Encoder] = HashEncoder) -> None:
    """Load every stored block with text into the vector table; nothing is parsed."""
    store_vectors(blocks.read(), vectors, make_encoder)


def to_parse(channel_frames: DataFrame | list[DataFrame], blocks: BucketTable, mode: str = "all",
             counts: Counts | None = None) -> tuple[DataFrame, DataFrame]:
    """The run's blocks, one per id, and those of them that still need parsing. Stored texts
    are looked for in the buckets of these blocks alone."""
    wanted = filters.by_mode(_together(channel_frames), mode)
    once = last_per_key(wanted.filter(F.col("id").isNotNull()), ["id"], ARRIVAL)
    if counts is not None:
        once = counts.of(once, blocks=F.count("*"), with_url=F.count_if(F.coalesce("source.url", F.lit("")) != ""))
    latest = written(once, "latest")
    return latest, filters.needs_parsing(latest, blocks.near(latest))


def ingest_channels(channel_frames: DataFrame | list[DataFrame], pages: DataFrame, blocks: BucketTable,
                    vectors: VectorTable | None, as_of, mode: str = "all", upsert_mode: str = "keep_text",
                    make_encoder: Callable[[], Encoder] = HashEncoder, counts: Counts | None = None) -> DataFrame:
    """Blocks of the channels, with the text of their landed pages, into both tables.

    Returns the addresses that gave no text, with the reason. Stored blocks that already
    have text are not parsed again. ``counts`` takes the figures of the run: blocks,
    with_url, parsed (pages converted), failed (of them without text) and with_text (blocks
    that got one).
    """
    latest, pending = to_parse(channel_frames, blocks, mode, counts)
    addresses = filters.has_source_url(pending).select(F.col("source.url").alias("url")).distinct()
    made = parse_pages(pages.join(addresses, "url", "left_semi"), mode == "pdf_only")
    if counts is not None:
        made = counts.of(made, parsed=F.count("*"), failed=F.count_if(F.col("content").isNull()))
    parsed = written(made, "parsed")
    content = parsed.filter(F.col("content").isNotNull()).select("source_url", "content")
    rows = block_rows(latest.drop(*ARRIVAL, "channel"), content)
    if counts is not None:
        rows = counts.of(rows, with_text=F.count_if(F.coalesce("crawled_text", F.lit("")) != ""))
    batch = written(rows, "batch")
    blocks.upsert(batch, lambda old, new: merge_parts(old, new, as_of, upsert_mode))
    if vectors is not None:
        store_vectors(blocks.lookup(batch.select("id")), vectors, make_encoder)
    return parsed.filter(F.col("content").isNull()).select("source_url", "route", "error")


def sync_channels(channel_frames: DataFrame | list[DataFrame], blocks: BucketTable, as_of, since=None, till=None,
                  titles: list[str] | None = None, upsert_mode: str = "keep_text") -> None:
    """The date-window sync of named channels: text is the block's own content field."""
    rows = _together(channel_frames)
    if titles is not None:
        rows = filters.channels_allowed(rows, titles)
    if since is not None:
        rows = filters.date_window(rows.withColumn("_at", F.try_to_timestamp("created_at")), since, till, "_at").drop("_at")
    latest = last_per_key(rows.filter(F.col("id").isNotNull()), ["id"], ARRIVAL)
    batch = written(block_rows(latest.drop(*ARRIVAL, "channel"), text_from="content"), "batch")
    blocks.upsert(batch, lambda old, new: merge_parts(old, new, as_of, upsert_mode))


def ingest_records(records: DataFrame, blocks: BucketTable, vectors: VectorTable | None,
                   make_encoder: Callable[[], Encoder] = HashEncoder, counts: Counts | None = None) -> DataFrame:
    """Submitted records into both tables; returns the rejects with a reason. The time of
    a record is its submission, so a replay writes the same rows. ``counts`` takes the
    figures accepted (records) and blocks (of them, one per id)."""
    good, rejects = submitted_blocks(records)
    if counts is not None:
        good = counts.of(good, accepted=F.count("*"))
    latest = last_per_key(good, ["id"], ["submitted_at", "title", "description", "content"])
    rows = block_rows(latest, text_from="record", keep=("submitted_at",))
    batch = written(rows if counts is None else counts.of(rows, blocks=F.count("*")), "records")
    blocks.upsert(batch, lambda old, new: merge_parts(old, new, F.col("submitted_at")))
    if vectors is not None:
        store_vectors(batch, vectors, make_encoder)
    return rejects
