"""Text forms of search hits and retrieval contexts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# The output formats of a hit and of a context entry.
SCORE_FORMAT = "%.3f"
ENTRY_SEPARATOR = "\n\n"


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def hit_text(score: Column, title: Column, url: Column, preview: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Score: "), F.format_string(SCORE_FORMAT, score)),
        F.concat(F.lit("Title: "), _shown(title)),
        F.concat(F.lit("URL: "), _shown(url)),
        F.concat(F.lit("Preview: "), tx.preview(_shown(preview)), F.lit("...")),
    )


def context_entry(rank: Column, title: Column, url: Column, preview: Column) -> Column:
    return F.concat(
        F.lit("Document "), rank.cast("string"), F.lit(":\n"),
        F.lit("Title: "), _shown(title), F.lit("\n"),
        F.lit("URL: "), _shown(url), F.lit("\n"),
        F.lit("Content: "), _shown(preview), F.lit("\n"),
    )
