"""Row filters and content routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .skew import spread_join

DEFAULT_SITES = ("https://en.wikipedia.org/",)  # fixed value: the default allow-list
WIKI_MARK = "wikipedia.org"  # fixed value: substring that selects the wiki route
MODES = ("all", "pdf_only", "wikipedia_only")


def has_source(df: DataFrame, source: str = "source") -> DataFrame:
    """Enough to be stored: there is a source at all."""
    return df.filter(F.col(source).isNotNull())


def has_source_url(df: DataFrame, url: str = "source.url") -> DataFrame:
    """Enough to be parsed: the address is neither null nor empty."""
    return df.filter(F.coalesce(F.col(url), F.lit("")) != "")


def site_allowed(df: DataFrame, allowed: list[str] | tuple[str, ...] | DataFrame = DEFAULT_SITES,
                 url: str = "source.url", spread_by: str = "id") -> DataFrame:
    """Rows whose ``scheme://authority/`` equals an entry. A list becomes an IN filter;
    a one-column table of any size becomes a semi join that spreads a hot site."""
    place = urls.site(F.col(url))
    if not isinstance(allowed, DataFrame):
        return df.filter(F.coalesce(place.isin(*allowed), F.lit(False)))
    table = allowed.select(F.col(allowed.columns[0]).alias("_site"))
    return spread_join(df.withColumn("_site", place), table, "_site", "left_semi", F.col(spread_by)).drop("_site")


def pdf_blocks(df: DataFrame, url: str = "source.url", content_type: str = "source.content_type") -> DataFrame:
    return has_source_url(df, url).filter(urls.is_pdf(F.col(url), F.col(content_type)))


def by_mode(df: DataFrame, mode: str = "all", url: str = "source.url",
            content_type: str = "source.content_type") -> DataFrame:
    """The blocks an ingest run looks at."""
    if mode == "pdf_only":
        return pdf_blocks(df, url, content_type)
    if mode == "wikipedia_only":
        return site_allowed(df, DEFAULT_SITES, url)
    if mode == "all":
        return df
    raise ValueError(f"mode must be one of {MODES}")


def route(url: Column, content_type: Column, pdf_only: bool = False) -> Column:
    """How a page is converted: pdf, skip, wiki or html."""
    chain = F.when(urls.is_pdf(url, content_type), "pdf")
    if pdf_only:
        return chain.otherwise("skip")
    return chain.when(url.contains(WIKI_MARK), "wiki").otherwise("html")


def date_window(df: DataFrame, since, till, column: str = "created_at") -> DataFrame:
    """since < column <= till; both bounds reach the scan."""
    return df.filter((F.col(column) > F.lit(since)) & (F.col(column) <= F.lit(till)))


def channels_allowed(df: DataFrame, titles: list[str] | DataFrame, title: str = "channel") -> DataFrame:
    if not isinstance(titles, DataFrame):
        return df.filter(F.col(title).isin(*titles))
    table = titles.select(F.col(titles.columns[0]).alias(title))
    return spread_join(df, table, title, "left_semi", F.xxhash64(*[c for c in df.columns if c != title]))


def has_text(df: DataFrame, text: str = "crawled_text") -> DataFrame:
    """Null and '' are not embedded; text of blanks is."""
    return df.filter(F.coalesce(F.col(text), F.lit("")) != "")


def needs_parsing(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks not stored, or stored without text ('' counts as parsed)."""
    return batch.join(stored.filter(F.col("crawled_text").isNotNull()).select("id"), "id", "left_anti")


def lookup(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored blocks of an id list of any length."""
    return blocks.join(ids.select("id").distinct(), "id", "left_semi")
