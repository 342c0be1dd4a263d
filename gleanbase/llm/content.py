"""Main text of web pages: text-to-tag ratio per line, smoothed, clustered by a threshold.

The standard library's streaming parser feeds events; block tags and line breaks cut the
page into lines. Elements whose class or id names what surrounds an article are left out,
unless they hold it themselves, which is decided at the end. A line's ratio is its letters outside links over its tags. The ratios are
smoothed with a Gaussian kernel and cut at a share of their deviation; regions (articles,
the main element, else the body) that hold lines above the cut are the content. Within it
go lines of three links or more and nothing else, copyright notices at the end of a region,
and articles that are teasers: a linked heading with less than a third of the text of the
largest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split())
OUTSIDE = frozenset(
    "head script style noscript template nav footer aside form iframe object svg math button select textarea "
    "dialog menu canvas audio video datalist".split())
CLOSES_P = BLOCK - {"br", "option", "select", "html", "head", "body", "td", "th", "tr"}
# Words of class and id that name what surrounds an article, and roles that do.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription menu navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars footer comment comments commentlist respond disqus share sharing social related popup modal overlay login "
    "signup widget pagination pager masthead topbar toolbar".split())
PAGE_HINTS = HINTS | {"header", "nav"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

SIGMA = 1.5  # lines
CUT = 0.5  # of the deviation of the smoothed ratios
LINKS = 3  # links of a line without other text, from which on it goes
TEASER = 3  # times a teaser's text, to stay below the largest region
COPYRIGHT = re.compile(r"(?i)(?:copyright\s+)?(?:\u00a9|\(c\)|copyright)\s*(?:19|20)\d\d\b.{0,200}$", re.DOTALL)


class _Lines(HTMLParser):
    """Cuts a page into lines: (text, letters outside links, tags, region, skipped, heading, links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.raw: list[tuple[list, int, int, bool, bool]] = []  # parts, tags, region, left out, heading
        self.open: list[tuple[str, bool, int, int]] = []  # name, skipped, region, hinted element
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name, in order
        self.regions = [0]  # the hinted element each stands in
        self.articles = [False]  # whether the region is an article
        self.hinted = [(0, "", False, 0)]  # the one around it, name, hint is a whole name, region around it
        self.mains = [False]  # whether a hinted element is or holds a main
        self.parts: list[tuple[str, int, bool]] = []  # text, hinted element, outside links
        self.tags = self.links = 0
        self.left_out = False  # text of elements around the content, since the last cut

    def _state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def cut(self) -> None:
        if self.parts or self.left_out:
            heading = bool(self.open) and self.open[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
            self.raw.append((self.parts, self.tags, self._state()[1], self.left_out, heading))
        self.parts, self.tags, self.left_out = [], 0, False

    def dropped(self) -> list[bool]:
        """Which hinted elements go, with all they hold. Those stay that are or hold the main
        element or over half of the text around them (of the page or the region); if the hint
        is only part of a name (has-sidebar), also articles outside others and what holds over
        half of the text of articles. In a region a whole name (comments) goes whatever it holds."""
        held, of_region = [0] * len(self.hinted), [0] * len(self.regions)
        for parts, _, region, *_ in self.raw:
            for text, hint, plain in parts:
                amount = len("".join(text.split())) if plain else 0
                held[hint] += amount
                of_region[region] += amount
        articles, mains = [0] * len(self.hinted), list(self.mains)
        for region, hint in enumerate(self.regions):
            articles[hint] += of_region[region] if region else 0
        for k in range(len(self.hinted) - 1, 0, -1):  # inner ones come after those around them
            around = self.hinted[k][0]
            held[around] += held[k]
            articles[around] += articles[k]
            mains[around] = mains[around] or mains[k]
        out = [False] * len(self.hinted)
        for k, (around, tag, whole, region) in enumerate(self.hinted[1:], 1):
            stays = mains[k] or 2 * held[k] > (of_region[region] if region else held[0])
            if whole:
                stays = mains[k] or stays and not region
            else:
                stays = stays or tag == "article" and not region or 2 * articles[k] > articles[0]
            out[k] = out[around] or not stays
        return out

    @property
    def lines(self) -> list[tuple[str, int, int, int, bool, bool, int]]:
        gone, lines = self.dropped(), []
        for parts, tags, region, left_out, heading in self.raw:
            kept = [(text, plain) for text, hint, plain in parts if not gone[hint]]
            text = " ".join("".join(t for t, _ in kept).split())
            if text or left_out or any(gone[hint] and not t.isspace() for t, hint, _ in parts):
                links = sum(not plain and not t.isspace() for t, plain in kept)
                lines.append((text, sum(len(t) for t, plain in kept if plain), tags, region, not text, heading, links))
        return lines

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", {"div", "article", "section", "main", "td", "body", "li"})
        elif tag == "li":
            self._close("li", {"ul", "ol", "menu"})
        if tag in BLOCK and tag not in ("html", "head", "title"):  # what stands in the body ends an open head
            self._close("head", {"body"})
        skipped, region, hint = self._state()
        hints = {k: v or "" for k, v in attrs}
        if not skipped:
            names = f"{hints.get('class', '')} {hints.get('id', '')}".lower()
            outer = HINTS if region else PAGE_HINTS
            skipped = (tag in OUTSIDE or tag == "header" and not region or hints.get("role", "").lower() in ROLES
                       or "hidden" in hints or hints.get("aria-hidden", "").lower() == "true")
            if not skipped and tag not in ("html", "body") and not outer.isdisjoint(re.split(r"[^a-z0-9]+", names)):
                self.hinted.append((hint, tag, not outer.isdisjoint(names.split()), region))
                self.mains.append(False)
                hint = len(self.hinted) - 1
        if tag in ("article", "main") and not skipped:
            self.regions.append(hint)
            self.articles.append(tag == "article")
            region = len(self.regions) - 1
            self.mains[hint] = self.mains[hint] or tag == "main"
        if tag == "a":
            self.links += 1
        self.places[tag].append(len(self.open))
        self.open.append((tag, skipped, region, hint))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1

    def _close(self, tag: str, until: set[str] = frozenset()) -> None:
        """Close the innermost ``tag`` and what is open within, unless one of ``until`` stands between."""
        if not self.places[tag]:
            return
        first = self.places[tag][-1]
        if any(self.places[name][-1] > first for name in until if name in self.places and self.places[name]):
            return
        for name, *_ in self.open[first:]:
            self.places[name].pop()
            self.links -= name == "a"
        del self.open[first:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        # a stray end tag of inline mark-up must not close what stands around it
        self._close(tag, set() if tag in BLOCK else BLOCK)

    def handle_data(self, data: str) -> None:
        if self._state()[0]:
            self.left_out = self.left_out or not data.isspace()
            return
        self.parts.append((data, self._state()[2], not self.links))


def ratios(lines: list[tuple]) -> np.ndarray:
    """Smoothed text-to-tag ratios."""
    raw = np.array([0.0 if skipped else plain / max(1, tags) for _, plain, tags, _, skipped, *_ in lines])
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(raw, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    lines = parser.lines
    if not lines:
        return ""
    smooth = ratios(lines)
    high = smooth >= CUT * smooth.std()
    chosen = {lines[k][3] for k in np.flatnonzero(high) if not lines[k][4]}
    inner = chosen - {0} or {line[3] for line in lines if line[3] and not line[4]}
    if inner:  # marked articles that hold content: their lines
        kept = _clean([k for k, line in enumerate(lines) if line[3] in inner and not line[4]], lines, parser.articles)
        return " ".join(lines[k][0] for k in kept)
    # no marked article: from the first to the last line of the cluster, with the headings before it
    hits = [k for k in np.flatnonzero(high) if not lines[k][4]]
    if not hits:
        return ""
    first = hits[0]
    while first and lines[first - 1][5] and not lines[first - 1][4]:
        first -= 1
    kept = _clean([k for k in range(first, hits[-1] + 1) if not lines[k][4]], lines, parser.articles)
    return " ".join(lines[k][0] for k in kept)


def _clean(kept: list[int], lines: list[tuple], articles: list[bool]) -> list[int]:
    """The lines of the content without what surrounds it there: link lists, teasers, notices.
    Where nothing else is left, all of them."""
    def bare(k: int) -> bool:  # links with separators between them
        _, plain, _, _, _, heading, links = lines[k]
        return not heading and links >= LINKS and plain <= 3 * links

    sizes, linked = defaultdict(int), set()
    for k in kept:
        _, plain, _, region, _, heading, links = lines[k]
        sizes[region] += plain
        if heading and links and not plain:
            linked.add(region)
    most = max(sizes.values(), default=0)
    teasers = {r for r in linked if articles[r] and TEASER * sizes[r] < most}
    out, ended = [], set()
    for k in reversed(kept):
        region = lines[k][3]
        if region in teasers or bare(k) or region not in ended and COPYRIGHT.match(lines[k][0]):
            continue
        ended.add(region)
        out.append(k)
    return out[::-1] or kept


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without the column ``html`` and with the main text of each whole page.

    Null, empty and mark-up without content give the empty text. Each page is read alone;
    repeated rows get equal answers. A column named as ``into`` is replaced.
    """
    pages = pages.drop(*[c for c in pages.columns if c.lower() == into.lower() and c != html])
    place = pages.columns.index(html)
    rest = [k for k in range(len(pages.columns)) if k != place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([main_text(value.as_py()) for value in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), made],
                                             [*(batch.schema.names[k] for k in rest), into])

    kept = T.StructType([pages.schema.fields[k] for k in rest])
    return pages.mapInArrow(run, appended(kept, **{into: T.StringType()}))
