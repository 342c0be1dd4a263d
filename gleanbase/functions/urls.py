"""URL columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme "://" authority, up to the path, query or fragment
AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"


def site(url: Column) -> Column:
    """``scheme://authority/`` with the scheme in lower case; the authority keeps its
    case, port and user part. A text without a scheme gives ``:///``."""
    scheme = F.lower(F.regexp_extract(url, AUTHORITY, 1))
    return F.concat(scheme, F.lit("://"), F.regexp_extract(url, AUTHORITY, 2), F.lit("/"))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 2)


def is_web_url(url: Column) -> Column:
    """An http or https address with a host."""
    found = F.lower(F.regexp_extract(url, AUTHORITY, 1)).isin("http", "https")
    return F.coalesce(found & (authority(url) != ""), F.lit(False))


def is_pdf(url: Column, content_type: Column | None = None) -> Column:
    """The address ends in .pdf, or the response type says so."""
    by_name = F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))
    if content_type is None:
        return by_name
    return by_name | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))
