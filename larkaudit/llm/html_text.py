"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block element gives a line. Lines are weighed by their text outside
links, and by marks: menus, notices, forms and the like weigh nothing, and where a page marks its
article, lines in it weigh more and others little. Weights are summed over sliding windows of lines.
The text surges where a window reaches a share of the page's heaviest one and dives where windows
hold next to nothing; what lies between is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkaudit.llm.common import bounded_batches

#: Lines in a window.
WINDOW = 3
#: The text surges at windows of this weight, or of this share of the heaviest window if that is less.
SURGE, SURGE_SHARE = 80.0, 0.25
#: It dives below this share of the surge.
DIVE_SHARE = 1 / 16
#: Added to the weight of a line of the page's article, and what the weight of other lines is divided by then.
ARTICLE_WEIGHT, OUTSIDE = 80.0, 64.0

#: Elements whose content is no markup and no text of the page. Fixed values.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
#: Elements whose content is not text of the page. Fixed values.
SILENT = {"noscript", "template", "svg", "object", "select", "button", "canvas", "audio", "video"}
#: Elements that hold no part of an article. Fixed values.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
#: Elements that begin a line. Fixed values.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Elements that are tracked as open, so that a mark on one holds for what is inside.
NESTED = (BLOCK - {"p", "hr", "html", "body"}) | {"span", "td", "th"}
#: Roles of elements that hold no part of an article. Fixed values.
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Words of class and id names that mark what is no part of an article. Fixed values.
MARKS = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist",
    "disqus", "respond", "replies", "reply", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "pagination",
    "pager", "toolbar", "login", "search", "skip", "teaser", "outbrain", "taboola",
}
#: Words that may stand beside a mark in a class or id name; with any other word the name is no mark. Fixed values.
LAYOUT = {
    "area", "article", "aside", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "entry", "footer", "form",
    "global", "header", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "post", "posts", "primary",
    "right", "row", "secondary", "section", "side", "site", "slot", "small", "sticky", "text", "thread", "top", "unit", "user", "wrap", "wrapper",
}
#: Class and id names that mark a page's header. Fixed values.
HEADERS = {"header", "site-header", "page-header", "top-header", "main-header", "global-header", "topbar", "top-bar"}

TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
STOP = re.compile("[>\"']")
END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW | SILENT}


class Line(NamedTuple):
    text: str
    linked: int  # characters of it within links
    inside: int  # 2: in an article, 1: in a main part


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(tag, attributes, whether it closes) and ("", text, False) in page order, in one pass; comments and silent elements are left out.

    Reading is linear in the page's length: what was sought once and is not there is not sought again.
    """
    at, missing = 0, set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while at < len(page):
        lt = find("<", at)
        if lt < 0:
            yield "", page[at:], False
            return
        if lt > at:
            yield "", page[at:lt], False
        if page.startswith("<!--", lt):
            stop = find("-->", lt + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", lt):
            stop = find("]]>", lt)
            at = len(page) if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = find(">", lt)
            at = len(page) if stop < 0 else stop + 1
            continue
        if find(">", lt) < 0:
            yield "", page[lt:], False
            return
        m = TAG.match(page, lt)
        if m is None:
            yield "", "<", False
            at = lt + 1
            continue
        stop = m.end()
        while True:
            s = STOP.search(page, stop)
            if s is None:  # all that is left lies in quotes
                stop = page.find(">", m.end())
                break
            stop = s.start()
            if s.group() == ">":
                break
            close = find(s.group(), stop + 1)
            stop = close + 1 if close >= 0 else stop + 1
        tag, attributes, closing = m.group(1).lower(), page[m.end() : stop], page[lt + 1] == "/"
        at = stop + 1
        if not closing and (tag in RAW or tag in SILENT and not attributes.endswith("/")):
            end = None if tag in missing else END[tag].search(page, at)
            if end is not None:
                at = end.start()
            else:
                missing.add(tag)
                if tag in RAW:
                    return
        yield tag, attributes, closing


def is_mark(name: str) -> bool:
    """Whether a class or id name holds a word of MARKS, and nothing that makes it another thing's name."""
    parts = [p for p in re.split(r"[-_]+", name) if p]
    return any(p in MARKS for p in parts) and all(p in MARKS or p in LAYOUT or p.isdigit() for p in parts)


def marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of an article."""
    if tag in ASIDE and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("main", "body", "html"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            for token in value.split():
                if token in HEADERS and not in_article:
                    return True
                if tag == "article":  # reader comments and teasers may be articles too
                    if token in MARKS or token.startswith("comment"):
                        return True
                elif is_mark(token):
                    return True
    return False


def page_lines(page: str) -> list[Line]:
    """The lines of a page that are not marked as no part of an article."""
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    linked = aside = articles = mains = 0
    link = skipped = False

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, linked, 2 if articles else 1 if mains else 0))
            parts.clear()
        linked = 0

    for tag, attributes, closing in tokens(page):
        if not tag:
            if not (aside or skipped):
                parts.append(attributes)
                if link:
                    linked += len(attributes.strip())
            continue
        if tag in BLOCK:
            end_line()
            # A paragraph need not be closed: a mark on one holds up to the next block.
            skipped = tag == "p" and not closing and marked(tag, attributes, articles > 0)
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        elif tag == "a":
            link = not closing
        if tag not in NESTED or attributes.endswith("/"):
            continue
        if not closing:
            off = marked(tag, attributes, articles > 0)
            if off:
                end_line()
            aside += off
            stack.append((tag, off))
            opened[tag] += 1
            articles += tag == "article" and not aside
            mains += tag == "main" and not aside
        elif opened[tag]:
            while True:
                t, off = stack.pop()
                opened[t] -= 1
                articles -= t == "article" and not aside
                mains -= t == "main" and not aside
                aside -= off
                if t == tag:
                    break
    end_line()
    return lines


def weights(lines: list[Line]) -> list[float]:
    best = max((x.inside for x in lines), default=0)
    if not best:
        return [float(max(len(x.text) - x.linked, 0)) for x in lines]
    return [len(x.text) + ARTICLE_WEIGHT if x.inside == best else max(len(x.text) - x.linked, 0) / OUTSIDE for x in lines]


def spans(weight: list[float]) -> list[tuple[int, int]]:
    """Line ranges between a surge and the dive after it, without lines of little weight at their ends."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    surge = min(SURGE, SURGE_SHARE * max(sums, default=0.0))
    if surge <= 0:
        return []
    found, begin = [], -1
    for i, total in enumerate([*sums, 0.0]):
        if begin < 0 and total >= surge:
            begin = i
        elif begin >= 0 and total < surge * DIVE_SHARE:
            found.append((begin, i))
            begin = -1
    out = []
    for a, b in found:
        while weight[a] < surge * DIVE_SHARE / 2:
            a += 1
        while weight[b - 1] < surge * DIVE_SHARE / 2:
            b -= 1
        out.append((a, b))
    return out


def main_text(page: str | None) -> str:
    """The lines of a page's article, joined by line ends; empty for null and for pages without text outside links and marks."""
    lines = page_lines(page) if page else []
    return "\n".join([lines[i].text for a, b in spans(weights(lines)) for i in range(a, b)])


def extracted(page: Column) -> Column:
    @F.pandas_udf(StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return texts(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html, ...).

    A null or empty html gives an empty text; null ids and urls stay; repeated rows each give a
    row; an empty table gives none; extra columns are ignored. Pages are read in one pass, in time
    linear in their length, however broken their markup is.
    """
    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
