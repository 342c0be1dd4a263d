"""Markdown cleanup and plain-text helpers as regular expressions in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blanks, as in Unicode, and U+001C to U+001F.
# Spelled out, because Java's own Unicode classes are several times slower to match.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_LINES = f"\n[{BLANKS}]*\n"
NUMBER_MARK = r"\[\p{Nd}+\]"
PREVIEW_LENGTH = 200  # fixed value: characters of text kept in a payload


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_LINES, "\n\n")


def drop_number_marks(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER_MARK, "")


def drop_literal(text: Column, literal: str) -> Column:
    return F.replace(text, F.lit(literal), F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_markdown(text: Column) -> Column:
    """Cleanup of converted text; null becomes ''."""
    text = F.coalesce(text, F.lit(""))
    text = drop_number_marks(collapse_blank_lines(text))
    return strip(drop_literal(drop_literal(text, "[edit]"), "[]"))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW_LENGTH)


def strip_html(html: Column) -> Column:
    """Visible text of a page without a parser: bodies of script and style, comments
    and tags go, blanks collapse. For counting and keyword work; markup structure is
    kept by the page conversion job instead."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def words(text: Column, min_length: int = 1) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}\p{{N}}]{{{min_length},}})"), F.lit(1))
