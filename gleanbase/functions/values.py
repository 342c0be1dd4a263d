"""JSON, defaults, dates and record ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(struct: Column) -> Column:
    """One JSON text per row, null fields written out."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def metadata_or_null(metadata: Column) -> Column:
    """Metadata JSON at rest; an empty object, empty text or JSON null is stored as null."""
    bare = F.regexp_replace(metadata, r"\s+", "")
    return F.when(bare.isin("", "{}", "[]", "null", "false", "0", '""'), None).otherwise(metadata)


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON text; null when the text is not JSON or the field is missing."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def is_bad_json(text: Column) -> Column:
    return text.isNotNull() & (text != "") & F.try_parse_json(text).isNull()


def text_or(value: Column, default: str) -> Column:
    """The text, or the default for null and ''."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def int_or(value: Column, default: int) -> Column:
    """Leading integer of a text, or the default."""
    digits = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(default))


def as_time(value: Column) -> Column:
    """ISO texts and plain dates; null when unreadable."""
    return F.try_to_timestamp(value)


def record_id(prefix: str, submitted_at: Column, name: Column) -> Column:
    """Prefix and time to the second, plus eight digits of the name's hash so that two
    records of one second stay apart."""
    return F.concat(
        F.lit(prefix),
        F.date_format(submitted_at, "yyyyMMdd_HHmmss"),
        F.lit("_"),
        F.substring(F.sha2(name, 256), 1, 8),
    )
