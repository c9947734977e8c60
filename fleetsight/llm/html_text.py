"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; what page structure marks as no part of the article (menus, headers,
footers, sidebars, notices, adverts, forms, comments) goes with it. Over the lines that are left, text lengths are summed
in a sliding window; the text starts where the sum surges and ends where it dives to nothing. Article elements are a hint:
where they hold most of the text, the window runs over their lines alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in the sliding window.
WINDOW = 3
#: A line block with fewer characters is outside the text; on pages whose densest block is short, below this share of it.
DIVE_CHARS = 60
DIVE_SHARE = 0.25
#: The same inside article elements, where titles and bylines are text: a block below it holds nothing but stray signs.
MAIN_DIVE_CHARS = 10
#: Article elements bound the text if they hold this share of the page's characters.
MAIN_SHARE = 0.5

# fixed values: element and attribute names of HTML
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "fieldset", "option", "datalist"}
MAIN = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted", "promotion", "related", "replies",
    "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
# words that a container's name adds to one of OUTSIDE_WORDS, and those of its place on the page, which only count outside articles
CONTAINER_WORDS = {
    "area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "links", "list", "main", "outer", "overlay",
    "panel", "post", "posts", "section", "slot", "thread", "unit", "wrap", "wrapper",
}
PLACE_WORDS = {"bottom", "footer", "global", "header", "left", "mobile", "page", "primary", "right", "secondary", "site", "sticky", "top"}
# fixed values: whole classes and ids of an article element that is no page's text
CARD_WORDS = {"ad", "ads", "advert", "card", "comment", "comments", "promo", "promoted", "related", "replies", "reply", "sponsored", "teaser", "teasers"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_WORD = re.compile(r"[a-z]+|[0-9]+")


def _names_outside(name: str, in_main: bool) -> bool:
    """Whether a class or id names a part outside the text: a known word, alone or with words of containers and numbers."""
    words = set(_WORD.findall(name))
    more = {w for w in words - OUTSIDE_WORDS if not w.isdigit()} - CONTAINER_WORDS
    return bool(OUTSIDE_WORDS & words) and not (more if in_main else more - PLACE_WORDS)


def _is_outside(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m.group(1) or "").lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value.strip() == "true":
            return True
        if name == "role" and value.strip() in OUTSIDE_ROLES:
            return True
        if name == "class" or name == "id" and tag not in HEADINGS:
            for one in value.split():
                if one in CARD_WORDS if tag in MAIN else _names_outside(one, in_main):
                    return True
    return False


def lines(html: str) -> list[tuple[str, bool]]:
    """(text, in an article element) of each block outside the page's structure, in page order; none is empty."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, is outside, is main
    outside = main = 0
    at = 0

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text and not outside:
            out.append((text, main > 0))

    for m in _MARKUP.finditer(html):
        if m.start() < at:
            continue
        if not outside:
            held.append(html[at : m.start()])
        at = m.end()
        if m.group(1) is None:
            if m.group(0).startswith("<![CDATA[") and not outside:
                held.append(m.group(0)[9:-3].replace("&", "&amp;"))
            continue
        tag, closing = m.group(1).lower(), m.group(0)[1] == "/"
        if tag == "br":
            held.append(" ")
        elif tag in RAW:
            if not closing and not m.group(2).rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                held.append(" " if tag == "textarea" else "")
        elif tag in VOID:
            if tag == "hr":
                close()
        elif closing:
            if any(t == tag for t, _, _ in stack):
                if tag in BLOCK or tag in OUTSIDE:
                    close()
                while stack:  # elements left open inside end with it
                    t, was_outside, was_main = stack.pop()
                    if was_outside and not outside - was_outside:
                        held.clear()
                    outside -= was_outside
                    main -= was_main
                    if t == tag:
                        break
            elif tag in BLOCK:
                close()
        else:
            gone = _is_outside(tag, m.group(2), main > 0)
            if tag in BLOCK or gone:
                close()
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):  # ends an open one of its kind
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        for _, o, n in stack[k:]:
                            outside -= o
                            main -= n
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
            stack.append((tag, gone, tag in MAIN))
            outside += gone
            main += tag in MAIN
    if not outside:
        held.append(html[at:])
    close()
    return out


def text_between(found: list[tuple[str, bool]], window: int = WINDOW) -> list[str]:
    """The lines between the surge and the dive of the summed text lengths."""
    held = sum(len(t) for t, inside in found if inside)
    least = DIVE_CHARS
    if held and held >= MAIN_SHARE * sum(len(t) for t, _ in found):
        found, least = [(t, inside) for t, inside in found if inside], MAIN_DIVE_CHARS
    if not found:
        return []
    sums = np.convolve([len(t) for t, _ in found], np.ones(window))
    block = np.maximum(sums[: len(found)], sums[window - 1 :])  # the denser of those that end and that start at a line
    above = np.flatnonzero(block >= min(least, DIVE_SHARE * block.max()))
    return [t for t, _ in found[above[0] : above[-1] + 1]]


def main_text(html: str | None) -> str:
    """The article's blocks, white space inside each turned to single blanks, joined by an empty line."""
    return "\n\n".join(text_between(lines(html))) if html else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, ``text``, ``n_chars`` in code points) of every page; the text is empty for null or bare pages.

    Repeated rows come back repeated, null ids and urls as null; extra columns are ignored.
    """
    mine = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return mine.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
