"""One pass over a page's tags: main content and Markdown.

A small helper of the parse job. Open elements lie on a stack; an element is rendered
when it closes and its text joins its parent. A stray end tag is ignored, any other
closes what is open up to its match, so no markup can make it fail.
"""

from __future__ import annotations

import re
from collections import Counter
from html import escape
from html.parser import HTMLParser

# What is cut from an encyclopedia page, and the element that is kept.
WIKI_CUT = (
    ".mw-editsection", "#mw-navigation", "#mw-head", "#mw-panel", "#footer",
    ".reference", ".references", ".reflist", ".navbox", ".thumb", ".infobox",
    ".mbox-small", "#coordinates", ".ambox", ".sistersitebox",
)
WIKI_MAIN = "mw-content-text"
CODE_LANGUAGE = "python"
BULLET = "-"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NO_TEXT = {"script", "style", "img"}
_PARAGRAPH = {"p", "div", "article", "section", "header", "footer", "main", "nav", "aside", "figure", "dl"}
_SPACES = re.compile(r"[ \t\r\n\f]+")
_HEADING = re.compile(r"h[1-6]$")


class _Open:
    __slots__ = ("tag", "attrs", "parts", "cut", "count")

    def __init__(self, tag: str, attrs: dict, cut: bool):
        self.tag, self.attrs, self.parts, self.cut, self.count = tag, attrs, [], cut, 0


class _Stack(list):
    """Open elements, with the number open of each tag."""

    def __init__(self):
        super().__init__([_Open("", {}, False)])
        self.open = Counter()

    def push(self, element: _Open) -> None:
        self.append(element)
        self.open[element.tag] += 1

    def take(self) -> _Open:
        element = self.pop()
        self.open[element.tag] -= 1
        return element


class _Walk(HTMLParser):
    """Renders every element through ``render(element, text, stack)``."""

    def __init__(self, render, render_text, cut=(), main=None):
        super().__init__(convert_charrefs=True)
        self.render, self.render_text, self.main = render, render_text, main
        self.cut_class = {s[1:] for s in cut if s.startswith(".")}
        self.cut_id = {s[1:] for s in cut if s.startswith("#")}
        self.stack = _Stack()
        self.found = None

    def _cut(self, attrs: dict) -> bool:
        return attrs.get("id") in self.cut_id or not self.cut_class.isdisjoint((attrs.get("class") or "").split())

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.stack.push(_Open(tag, attrs, self.stack[-1].cut or self._cut(attrs)))
        if tag in _VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close()

    def handle_endtag(self, tag):
        if self.stack.open[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data):
        top = self.stack[-1]
        if not top.cut:
            top.parts.append(self.render_text(data, self.stack))

    def _close(self) -> str:
        done = self.stack.take()
        if not done.cut:
            text = self.render(done, "".join(done.parts), self.stack)
            if self.main and self.found is None and done.attrs.get("id") == self.main:
                self.found = text
            self.stack[-1].parts.append(text)
        return done.tag

    def result(self, page: str) -> str | None:
        self.feed(page)
        self.close()
        while len(self.stack) > 1:
            self._close()
        return self.found if self.main else "".join(self.stack[0].parts)


def _as_html(e: _Open, text: str, stack) -> str:
    attrs = "".join(f' {k}="{escape(v)}"' if v is not None else f" {k}" for k, v in e.attrs.items())
    return f"<{e.tag}{attrs}>" + ("" if e.tag in _VOID else f"{text}</{e.tag}>")


def _html_text(data: str, stack) -> str:
    return data if stack[-1].tag in ("script", "style") else escape(data, quote=False)


def _inside(stack, *tags) -> bool:
    return any(stack.open[t] for t in tags)


def _nearest(stack, *tags) -> _Open | None:
    return next((e for e in reversed(stack) if e.tag in tags), None)


def _md_text(data: str, stack) -> str:
    if _inside(stack, "pre"):
        return data
    data = _SPACES.sub(" ", data)
    if data == " " and stack[-1].tag in ("html", "head", "ul", "ol", "table", "thead", "tbody", "tr"):
        return ""
    return data if _inside(stack, "code") else data.replace("*", r"\*").replace("_", r"\_")


def _wrapped(text: str, mark: str) -> str:
    inner = text.strip()
    if not inner:
        return text and " "
    lead = " " if text[0].isspace() else ""
    tail = " " if text[-1].isspace() else ""
    return f"{lead}{mark}{inner}{mark}{tail}"


def _list_item(text: str, stack) -> str:
    parent = _nearest(stack, "ul", "ol")
    mark = BULLET + " "
    if parent is not None and parent.tag == "ol":
        start = parent.attrs.get("start") or "1"
        mark = f"{(int(start) if start.isdecimal() else 1) + parent.count}. "
        parent.count += 1
    body = text.strip().replace("\n", "\n" + " " * len(mark))
    return f"{mark}{body}\n"


def _table_row(text: str, stack) -> str:
    table = _nearest(stack, "table")
    first = table is None or table.count == 0
    if table is not None:
        table.count += 1
    row = f"| {text.strip()}\n"
    width = len(re.findall(r"(?<!\\)\|", row)) - 1
    return row + ("|" + " --- |" * width + "\n" if first and width else "")


def _as_markdown(e: _Open, text: str, stack) -> str:
    tag = e.tag
    if tag in _NO_TEXT:
        return ""
    if _inside(stack, "pre") and tag != "pre":
        return "\n" if tag == "br" else text
    if _HEADING.match(tag):
        line = " ".join(text.split())
        return f"\n\n{'#' * int(tag[1])} {line}\n\n" if line else ""
    if tag in _PARAGRAPH or tag == "title":
        return f"\n\n{text.strip()}\n\n" if text.strip() else ""
    if tag in ("b", "strong"):
        return _wrapped(text, "**")
    if tag in ("i", "em"):
        return _wrapped(text, "*")
    if tag == "code":
        return _wrapped(text, "`")
    if tag == "a":
        href = e.attrs.get("href")
        if not href or not text.strip():
            return text
        lead, tail = text[:1].isspace() * " ", text[-1:].isspace() * " "
        return f"{lead}[{text.strip()}]({href}){tail}"
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "pre":
        return f"\n\n```{CODE_LANGUAGE}\n{text.strip(chr(10))}\n```\n\n" if text.strip() else ""
    if tag == "blockquote":
        lines = re.sub(r"\n\s*\n", "\n\n", text.strip()).split("\n")
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in lines) + "\n\n" if text.strip() else ""
    if tag in ("ul", "ol"):
        body = text.rstrip("\n") + "\n"
        return "\n" + body if _inside(stack, "li") else f"\n\n{body}\n"
    if tag == "li":
        return _list_item(text, stack)
    if tag in ("td", "th"):
        return " " + " ".join(text.split()).replace("|", r"\|") + " |"
    if tag == "tr":
        return _table_row(text, stack)
    if tag == "table":
        return f"\n\n{text.strip()}\n\n"
    return text


def main_content(page: str, cut=WIKI_CUT, main: str = WIKI_MAIN) -> str | None:
    """HTML of the element with the main id, without the cut elements; None without it."""
    return _Walk(_as_html, _html_text, cut, main).result(page)


def to_markdown(page: str) -> str:
    return _Walk(_as_markdown, _md_text).result(page)


def wiki_markdown(page: str, cut=WIKI_CUT, main: str = WIKI_MAIN) -> str | None:
    """Main content as Markdown in one pass."""
    return _Walk(_as_markdown, _md_text, cut, main).result(page)
