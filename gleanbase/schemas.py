"""Explicit schemas; nothing is inferred, so a missing field reads as null."""

from pyspark.sql import types as T

_s = T.StringType()

IMAGE = T.StructType([
    T.StructField("square", T.StructType([T.StructField("url", _s)])),
    T.StructField("large", T.StructType([T.StructField("url", _s)])),
])

RAW_BLOCK = T.StructType([
    T.StructField("id", _s),
    T.StructField("title", _s),
    T.StructField("description", _s),
    T.StructField("content", _s),
    T.StructField("created_at", _s),
    T.StructField("metadata", _s),
    T.StructField("source", T.StructType([
        T.StructField("url", _s), T.StructField("content_type", _s)])),
    T.StructField("image", IMAGE),
])

CHANNEL_PAGE = T.StructType([
    T.StructField("channel", _s),
    T.StructField("page", T.LongType()),
    T.StructField("contents", T.ArrayType(RAW_BLOCK)),
])

CHANNEL_HEADER = T.StructType([
    T.StructField("slug", _s),
    T.StructField("title", _s),
    T.StructField("contents", T.ArrayType(RAW_BLOCK)),
])

# The stored block table.
BLOCK = T.StructType([
    T.StructField("id", _s, False),
    T.StructField("source_url", _s),
    T.StructField("crawled_text", _s),
    T.StructField("title", _s),
    T.StructField("description", _s),
    T.StructField("metadata", _s),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("full_json", _s),
])
BLOCK_VALUES = ["source_url", "full_json", "crawled_text", "title", "description", "metadata"]

PAYLOAD = T.StructType([
    T.StructField("block_id", _s),
    T.StructField("title", _s),
    T.StructField("description", _s),
    T.StructField("source_url", _s),
    T.StructField("text_preview", _s),
])

VECTOR_POINT = T.StructType([
    T.StructField("id", _s, False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    T.StructField("payload", PAYLOAD),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", _s),
    T.StructField("html", _s),
    T.StructField("content_type", _s),
])

SUBMISSION = T.StructType([
    T.StructField("url", _s),
    T.StructField("file_name", _s),
    T.StructField("title", _s),
    T.StructField("description", _s),
    T.StructField("metadata", _s),
    T.StructField("content", _s),
    T.StructField("submitted_at", T.TimestampType()),
])

SAMPLE_CSV = T.StructType([
    T.StructField("block_id", _s),
    T.StructField("title", _s),
    T.StructField("description", _s),
    T.StructField("source_url", _s),
])
