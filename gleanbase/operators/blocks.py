"""Raw blocks to stored rows, the upsert, and vector payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..functions import values as v
from .filters import has_text
from .skew import salted_join
from .spread import small_enough

MODES = ("keep_text", "overwrite", "newer")


def attach_content(blocks: DataFrame, content: DataFrame, url: str = "source_url", spread_by: str = "id") -> DataFrame:
    """Left join of converted text by address; many blocks may share one address."""
    return salted_join(blocks, content.select(F.col("source_url").alias(url), "content"), url, "left", F.col(spread_by))


def block_rows(raw: DataFrame, content: DataFrame | None = None, text_from: str = "parsed",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw blocks to rows of the block table (without the timestamps) and columns to keep.

    ``parsed`` takes the text of the page conversion and ``record`` the text that came
    with the row; both need a source and keep the metadata. ``content`` takes the block's
    own content field, needs no source and stores '' as metadata.
    """
    rows = raw.filter(F.col("id").isNotNull())
    if text_from != "content":
        rows = rows.filter(F.col("source").isNotNull())
    names = [f.name for f in schemas.RAW_BLOCK.fields if f.name in raw.columns]
    own = "content" in names
    if text_from == "record":
        names.remove("content")
    base = rows.select(
        F.col("id").cast("string").alias("id"),
        F.col("source.url").alias("source_url"),
        v.json_text(F.struct(*names)).alias("full_json"),
        F.col("content").alias("_own") if own else F.lit(None).cast("string").alias("_own"),
        "title",
        "description",
        v.metadata_or_null(F.col("metadata")).alias("metadata"),
        *keep,
    )
    if text_from == "content":
        base = base.withColumn("crawled_text", F.col("_own")).withColumn("metadata", F.lit(""))
    elif text_from == "record":
        base = base.withColumn("crawled_text", F.col("_own"))
    elif text_from != "parsed":
        raise ValueError("text_from must be 'parsed', 'record' or 'content'")
    elif content is None:
        base = base.withColumn("crawled_text", F.lit(None).cast("string"))
    else:
        base = attach_content(base, content).withColumnRenamed("content", "crawled_text")
    return base.select("id", *schemas.BLOCK_VALUES, *keep)


def merge_blocks(stored: DataFrame, batch: DataFrame, as_of, mode: str = "keep_text",
                 newer_col: str = "updated_at") -> DataFrame:
    """Upsert by id, see ``merge_parts``."""
    kept, added = merge_parts(stored, batch, as_of, mode, newer_col)
    return kept.unionByName(added)


def merge_parts(stored: DataFrame, batch: DataFrame, as_of, mode: str = "keep_text",
                newer_col: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """Upsert by id: the stored rows brought up to date, and the new rows. ``batch`` has
    one row per id.

    Known ids take every value of the batch, nulls included, keep created_at and get
    updated_at = as_of. ``keep_text`` lets a null text leave the stored text alone,
    ``overwrite`` does not, and ``newer`` applies a batch row only where its
    ``newer_col`` is later than the stored updated_at. New ids get both times.

    A batch whose size is found small enough to broadcast updates the stored rows where they lie: the wide
    stored side is then neither shuffled nor sorted.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    names = schemas.BLOCK_VALUES
    fresh = batch.select(
        "id",
        *[F.col(c).alias(f"_{c}") for c in names],
        (F.col(newer_col) if mode == "newer" else now).cast("timestamp").alias("_at"),
    )
    hit = F.col("_at").isNotNull()
    if mode == "newer":
        hit = F.coalesce(F.col("_at") > F.col("updated_at"), F.lit(False))
    stamp = F.col("_at")

    def value(c: str) -> Column:
        new = F.coalesce(F.col(f"_{c}"), F.col(c)) if mode == "keep_text" and c == "crawled_text" else F.col(f"_{c}")
        return F.when(hit, new).otherwise(F.col(c)).alias(c)

    order = [f.name for f in schemas.BLOCK.fields]
    changes = F.broadcast(fresh) if small_enough(fresh) else fresh
    kept = stored.join(changes, "id", "left").select(
        "id", *[value(c) for c in names], "created_at",
        F.when(hit, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*order)
    known = stored.select("id").join(batch.select("id"), "id", "left_semi")
    added = fresh.join(known, "id", "left_anti").select(
        "id", *[F.col(f"_{c}").alias(c) for c in names],
        stamp.alias("created_at"), stamp.alias("updated_at"),
    ).select(*order)
    return kept, added


def payload(df: DataFrame) -> Column:
    """What a vector point carries: the block's fields and the head of its text. A field
    the table lacks becomes '', a stored null stays null."""
    def field(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit("")
    return F.struct(
        F.col("id").cast("string").alias("block_id"),
        field("title").alias("title"),
        field("description").alias("description"),
        field("source_url").alias("source_url"),
        tx.preview(F.col("crawled_text")).alias("text_preview"),
    )


def payload_rows(blocks: DataFrame) -> DataFrame:
    """Blocks worth embedding with their payload."""
    rows = has_text(blocks)
    return rows.select("id", "crawled_text", payload(rows).alias("payload"))


def replace_by_id(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Last write wins for whole rows."""
    kept, added = replace_parts(stored, batch, key)
    return added.unionByName(kept)


def replace_parts(stored: DataFrame, batch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    ids = batch.select(key)
    return stored.join(F.broadcast(ids) if small_enough(batch) else ids, key, "left_anti"), batch


def submitted_blocks(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records added by address or by file to raw blocks, and rejects with a reason.

    A file's name stands for its address and must end in .pdf; the extracted text comes
    with the record.
    """
    from ..functions import urls

    by_file = F.col("file_name").isNotNull()
    name = F.coalesce(F.col("file_name"), F.col("url"))
    reason = (
        F.when(name.isNull() | (name == ""), "no address")
        .when(by_file & ~urls.is_pdf(F.col("file_name")), "not a pdf file")
        .when(~by_file & ~urls.is_web_url(F.col("url")), "bad address")
        .when(v.is_bad_json(F.col("metadata")), "bad metadata")
        .when(F.coalesce(F.col("content"), F.lit("")) == "", "no content")
        .when(F.col("submitted_at").isNull(), "no time")
    )
    judged = records.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).select(
        F.when(by_file, v.record_id("file_", F.col("submitted_at"), name))
        .otherwise(v.record_id("manual_", F.col("submitted_at"), name)).alias("id"),
        F.struct(name.alias("url"), F.lit(None).cast("string").alias("content_type")).alias("source"),
        "title", "description", "metadata", "content", "submitted_at",
    )
    return good, judged.filter(F.col("reason").isNotNull())
