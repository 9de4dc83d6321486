"""Main text of HTML pages: flat text blocks, neighbour features, a decision tree.

A page is cut into flat blocks at block-level tags; inline tags and line breaks stay inside a block. Each
block carries its word count and link density (share of its words inside links), those of the block before and
after it, whether it lies in the page's article element, and whether a container around it is marked as something
else (menu, header, footer, sidebar, notice, advert, form, comments; by element, role, or class and id words). A class or id speaks
of a part only when no word of it says otherwise (``has-sidebar``, ``form-page``), and a container marked by class that holds
the page's first article, or on a page without one more than half of the words outside links (comments excepted), is a wrapper.
A decision tree trained on ``LABELLED`` decides which blocks are main text.

Elements without readable text (scripts, styles, form controls, head, comments, hidden elements) give no block.
Character references are decoded after the markup is gone; white space in a block becomes one space.

Cases: a null or empty page, or one without main text, gives an empty text; broken or unclosed markup is read to its
end (an unclosed script or comment hides the rest, as in a browser); repeated pages are separate rows; an empty table
gives no row. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_arrow, text_list

TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Names of the HTML standard and usual class names.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "select", "button", "audio", "video"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
OTHER = {"nav", "footer", "aside", "form", "dialog", "menu", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "note"}
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
         "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "aside", "widget", "widgets", "cookie", "cookies",
         "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share",
         "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus",
         "form", "search", "searchbox", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer", "toc", "teaser", "trending", "header"}
DENIALS = {"has", "have", "no", "not", "with", "without", "is", "hide"}
PAGES = {"page", "layout", "wrapper", "wrap", "container", "content", "body", "site", "template", "theme", "root", "app"}
COMMENTS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus"}
HIDES_REST = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}  # unclosed, they hide what follows
WHOLE = {"html", "body", "article", "main"}  # their classes describe the page, not a part of it

# The labelled table: words, link density, words before, link density before, words after, link density after,
# place (1 in the article, 0 page without one, -1 outside it), marked container (0/1); main text or not.
LABELLED = [
    (45, 0.00, 9, 0.00, 60, 0.00, 1, 0, 1), (9, 0.00, 2, 0.00, 45, 0.00, 1, 0, 1), (1, 0.00, 30, 0.00, 25, 0.00, 1, 0, 1),
    (4, 1.00, 50, 0.02, 40, 0.00, 1, 0, 1), (120, 0.10, 80, 0.00, 3, 0.00, 1, 0, 1), (2, 0.00, 0, 0.00, 0, 0.00, 1, 0, 1),
    (12, 0.50, 60, 0.00, 12, 0.50, 1, 0, 1), (30, 0.00, 1, 0.00, 1, 1.00, 1, 0, 1), (70, 0.03, 70, 0.00, 0, 0.00, 1, 0, 1),
    (3, 0.00, 1, 1.00, 90, 0.00, 1, 0, 1), (5, 0.00, 2, 1.00, 12, 0.00, 1, 0, 1), (2, 0.00, 4, 0.90, 40, 0.00, 1, 0, 1),
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 1, 0), (9, 0.00, 60, 0.00, 50, 0.00, 1, 1, 0), (40, 0.00, 60, 0.00, 50, 0.00, 1, 1, 0),
    (2, 0.00, 50, 0.00, 20, 0.00, 1, 1, 0), (90, 0.05, 20, 0.00, 10, 0.00, 1, 1, 0), (5, 0.80, 90, 0.00, 5, 0.80, 1, 1, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, -1, 1, 0), (8, 0.00, 1, 1.00, 9, 0.00, -1, 1, 0), (6, 0.00, 70, 0.00, 0, 0.00, -1, 1, 0),
    (30, 0.00, 6, 0.00, 0, 0.00, -1, 1, 0), (12, 0.00, 80, 0.00, 4, 0.00, -1, 0, 0), (3, 0.33, 1, 1.00, 10, 0.00, -1, 0, 0),
    (60, 0.00, 2, 0.00, 5, 0.50, -1, 0, 0), (25, 0.40, 9, 0.00, 3, 0.00, -1, 0, 0), (1, 0.00, 0, 0.00, 1, 1.00, -1, 0, 0),
    (40, 0.00, 8, 0.00, 60, 0.00, 0, 0, 1), (75, 0.05, 40, 0.00, 3, 1.00, 0, 0, 1), (18, 0.00, 55, 0.00, 70, 0.00, 0, 0, 1),
    (3, 0.00, 40, 0.00, 35, 0.00, 0, 0, 1), (8, 0.00, 2, 0.90, 60, 0.00, 0, 0, 1), (14, 0.00, 30, 0.00, 2, 1.00, 0, 0, 1),
    (16, 0.10, 1, 1.00, 45, 0.00, 0, 0, 1), (35, 0.20, 50, 0.00, 40, 0.05, 0, 0, 1), (11, 0.00, 12, 0.00, 13, 0.00, 0, 0, 1),
    (7, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (2, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (40, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0), (2, 1.00, 0, 0.00, 2, 1.00, 0, 0, 0), (5, 0.80, 3, 1.00, 40, 0.00, 0, 0, 0),
    (20, 0.60, 40, 0.00, 5, 0.90, 0, 0, 0), (4, 0.75, 60, 0.00, 0, 0.00, 0, 0, 0), (30, 0.90, 30, 0.90, 30, 0.90, 0, 0, 0),
    (3, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0), (2, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0), (4, 0.00, 3, 0.80, 2, 0.60, 0, 0, 0),
    (1, 1.00, 20, 0.00, 1, 1.00, 0, 1, 0), (9, 0.00, 1, 1.00, 40, 0.00, 0, 1, 0), (50, 0.00, 60, 0.00, 60, 0.00, 0, 1, 0),
    (6, 0.00, 70, 0.00, 0, 0.00, 0, 1, 0), (25, 0.10, 2, 0.00, 30, 0.00, 0, 1, 0), (100, 0.00, 40, 0.00, 10, 0.00, 0, 1, 0),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """Classification tree by the Gini measure: a label, or (feature, threshold, tree at or below, tree above)."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            score = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(cut))
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def decide(node, row) -> int:
    while not isinstance(node, int):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


def _marked(name: str, attributes: str, article: bool) -> tuple[bool, set[str], bool]:
    """(another part of the page by its element or role, by which words of its classes and id, hidden)."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if name in OTHER or found.get("role") in ROLES:
        return True, set(), hidden
    words: set[str] = set()
    if name not in WHOLE:
        for token in f"{found.get('class', '')} {found.get('id', '')}".split():
            parts = re.findall(r"[a-z]+", token)
            if parts and not DENIALS & set(parts) and (parts[-1] not in PAGES or len(parts) == 1):
                words |= MARKS & set(parts)
    return False, words - {"header"} if article else words, hidden


def blocks(page: str) -> tuple[list[tuple[str, int, int, bool, bool]], bool]:
    """Flat blocks (text, words, words in links, in article, marked) in page order; whether the page has an article."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, bool, tuple[int, ...], bool, bool]] = []  # element, other part, marks, hidden, article: with what is around it
    marks: list[set[str]] = []  # the words that marked each container
    wrappers: set[int] = set()
    other = hidden = article = has_article = False
    around: tuple[int, ...] = ()
    links, at, end = 0, 0, len(page)

    def close():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, text.count(" ") + 1, min(linked, text.count(" ") + 1), article, other, around))
        parts, linked = [], 0

    def add(raw: str):
        nonlocal linked
        if raw and not hidden:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.split())

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "p":
                close()
            elif name not in INLINE:
                close()
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if k is not None:
                    _, other, around, hidden, article = stack[k]
                    del stack[k:]
            continue
        if name in RAW:
            if not m[4].endswith("/") or name in ("script", "style", "title", "textarea"):
                m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = m.end() if m else end if name in HIDES_REST else at
            if name not in INLINE and name != "button":
                close()
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links += 1
        elif name in VOID:
            if name not in INLINE:
                close()
        elif name not in INLINE:
            close()
            links = 0
            if name != "p":
                stack.append((name, other, around, hidden, article))
                apart, words, hide = _marked(name, m[4], article)
                if name == "header" and not article:
                    apart = True
                if name in ("article", "main"):
                    if not has_article and not other and not any(marks[k] & COMMENTS for k in around):
                        has_article = True
                        wrappers.update(around)
                    article = True
                if words:
                    around = (*around, len(marks))
                    marks.append(words)
                other, hidden = other or apart, hidden or hide
        else:
            hide = _marked(name, m[4], article)[2] if m[4] else False
            if hide:  # a hidden inline element: its text up to the end tag is left out
                m = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = m.end() if m else end
    close()
    if marks and not has_article:
        free = [(words - linked, around) for _, words, linked, _, other, around in out if not other]
        total = sum(n for n, _ in free)
        wrappers.update(k for k, words in enumerate(marks) if not words & COMMENTS and 2 * sum(n for n, a in free if k in a) > total)
    return [(text, words, linked, article, other or not wrappers.issuperset(around)) for text, words, linked, article, other, around in out], has_article


def main_text(page: str) -> str:
    found, has_article = blocks(page)
    none = ("", 0, 0, False, False)
    kept, root = [], tree()
    for i, (text, words, linked, article, marked) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        row = (words, linked / words, before[1], before[2] / max(1, before[1]), after[1], after[2] / max(1, after[1]),
               (1 if article else -1) if has_article else 0, int(marked))
        if decide(root, row):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    def run(b):
        texts = [main_text(x) for x in text_list(b.column("html"))]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_arrow(pages, run, "page_id long, url string, text string, n_chars long")
