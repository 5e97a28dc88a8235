"""Main text of web pages by tag-path ratios.

Each text node hangs on a root-to-leaf path of tags, inline ones too; the parts of a block's text on one
path, between inline elements, are one node. Text length and punctuation are
summed per path and divided by the nodes that the path has; both ratios are smoothed along the page's
nodes and fused by their product. A block's ratio is the mean of its nodes' by length, and the score of a
block's path is the geometric mean of its own and its smoothed fused ratio; a threshold picks the content
paths. The path with the most weight tells the container, which decides where ratios can't: for the
headings, lists, tables and other text structure that stand in it, and for doubtful paths outside an
<article> or <main>. A path with a wrapper of its own in the container is left to its ratios.
Parts that are never an article (navigation, forms, scripts ...) are left out before, by tag. Words of
class, id and role that name other parts, and links, only lower the score of a path: words on what holds
the path with the most weight count for nothing, and links within the container don't count.

One Arrow pass; a page is read whole, however long. Defined results: a null or empty page and one of
nothing but links have an empty text; markup that is cut off or never closed is read as far as it goes;
pages without any container give their text; of paths with equal weight, the last by name is best; rows
that repeat an id are read apart; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# The tags of HTML by what they do.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "search", "fieldset"} | RAW
#: Words of class, id or role that name other parts of a page.
OTHER = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "aside", "complementary", "widget",
    "footer", "contentinfo", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "dialog", "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing",
    "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager",
    "copyright", "disclaimer", "skip", "hidden", "toc",
}
#: A new one of these ends an open one of the same row.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"table", "td", "th", "div", "section", "article", "main", "body", "ul", "ol", "dl", "blockquote", "aside", "nav", "header", "footer", "form"}
MARKS = re.compile(r"[.,;:!?…。，！？、»«\"]")
#: Tags that say nothing of the text in them, and those that give it a structure.
WRAPS = {"div", "section", "center", "article", "details", "dir", "hgroup", "address"}
SHAPES = {"ul", "ol", "dl", "table", "pre", "blockquote", "figure", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Shares of the best path's score: content by itself, and content outside an <article> or <main>.
FUSED, CLEAR, LINKS = 0.15, 0.5, 0.5
#: Factors of a name of another part (a whole name, a word of one), and of either on a section of the article.
NAMES, SECTION = {"!": 0.1, "~": 0.3}, 0.4
#: The best path has no whole name below its last <article> or <main>, where so much of the text has none.
UNNAMED = 0.1


def _other(tag: str, attributes: str, stack: list) -> tuple[bool, str]:
    """Whether an element is left out, and its mark: ! if a class, id or role of it names another part of
    a page, ~ if a word of one does."""
    if tag in NEVER or (tag == "header" and not any(t in ("article", "main", "section") for t, *_ in stack)):
        return True, ""
    mark = ""
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True, ""
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and mark != "!":
            mark = "!" if OTHER & set(value.split()) else "~" if OTHER & set(re.split(r"[^a-z]+", value)) else mark
    return False, mark


def _tag(element: str) -> str:
    return element.rstrip("!~")


Path = tuple[str, ...]


def blocks(page: str) -> list[tuple[Path, str, int, list[tuple[Path, int, int]]]]:
    """(path, text, characters within links, nodes) of each block that may be content, in page order. A path
    has its elements' marks; a block's has its block elements, that of a node (path, length, punctuation) all."""
    out: list[tuple[Path, str, int, list[tuple[Path, int, int]]]] = []
    stack: list[tuple[str, bool, bool, str]] = []  # tag, left out, link, mark
    buffer: list[str] = []
    path: Path = ()
    nodes: dict[Path, tuple[int, int]] = {}
    linked = at = 0

    def flush():
        nonlocal linked, nodes
        text = " ".join("".join(buffer).split())
        if text:
            out.append((path, text, linked, [(p, n, m) for p, (n, m) in nodes.items()]))
        buffer.clear()
        nodes, linked = {}, 0

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] == "<" and len(m[0]) > 1:
                continue
            if not (stack and stack[-1][1]):
                if not buffer:
                    path = tuple(t + mark for t, _, _, mark in stack if t in BLOCK)
                text = html.unescape(m[0])
                buffer.append(text)
                n = len(text.strip())
                if n:
                    whole = tuple(t + mark for t, _, _, mark in stack)
                    before = nodes.get(whole, (0, 0))
                    nodes[whole] = before[0] + n, before[1] + len(MARKS.findall(text))
                if stack and stack[-1][2]:
                    linked += n
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i][0] in HOLDS:
                    break
            continue
        if tag in BLOCK:
            flush()
            ends = ENDS.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    if tag not in ENDS:
                        break
                elif stack[i][0] in HOLDS and stack[i][0] not in ends:
                    break
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if not end else max(at, page.find(">", end.start()) + 1 or len(page))
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and buffer and tag != "wbr":
                buffer.append(" ")
            continue
        left_out, mark = (True, "") if stack and stack[-1][1] else _other(tag, m[3], stack)
        stack.append((tag, left_out, tag == "a" or bool(stack and stack[-1][2]), mark))
    flush()
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.25, 0.5, 1.0, 0.5, 0.25])
    at = slice(2, 2 + len(x))
    return np.convolve(x, kernel)[at] / np.convolve(np.ones(len(x)), kernel)[at]


def ratios(nodes: list[tuple[Path, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text node, in page order: the fused ratio of its path, and that of the smoothed ratios."""
    length, marks, times = {}, {}, {}
    for path, n, m in nodes:
        length[path] = length.get(path, 0) + n
        marks[path] = marks.get(path, 0) + m
        times[path] = times.get(path, 0) + 1
    text, punctuation = (np.array([of[p] / times[p] for p, _, _ in nodes]) for of in (length, marks))
    return text * (1 + punctuation), _smooth(text) * (1 + _smooth(punctuation))


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two line ends."""
    found = [b for b in blocks(page or "") if b[3]]
    if not found:
        return ""
    own_ratio, smoothed = ratios([n for *_, nodes in found for n in nodes])
    sizes = np.array([n for *_, nodes in found for _, n, _ in nodes], float)
    at = np.cumsum([0] + [len(nodes) for *_, nodes in found])[:-1]
    mean = lambda x: np.add.reduceat(x * sizes, at) / np.add.reduceat(sizes, at)
    length, times, links, own, near, weight = {}, {}, {}, {}, {}, {}
    for path, text, linked, _ in found:
        length[path] = length.get(path, 0) + len(text)
        times[path] = times.get(path, 0) + 1
        links[path] = links.get(path, 0) + linked
    unlinked = {p: max(0.0, 1 - links[p] / length[p]) for p in times}
    for (path, text, _, _), r, f in zip(found, mean(own_ratio), mean(smoothed)):
        own[path] = own.get(path, 0.0) + r / times[path]
        near[path] = near.get(path, 0.0) + f / times[path]
        weight[path] = weight.get(path, 0.0) + f * len(text) * unlinked[path] * math.prod(NAMES.get(x[-1], 1) for x in path)
    if not max(weight.values()):  # nothing but links
        return ""
    score = {p: float(np.sqrt(near[p] * own[p])) for p in times}
    unnamed = [p for p in times if not any(x[-1] == "!" for x in p[max((i for i, x in enumerate(p) if x in ("article", "main")), default=0) :])]
    able = {p: length[p] * unlinked[p] for p in times}
    best = max(unnamed if sum(able[p] for p in unnamed) >= UNNAMED * sum(able.values()) else times, key=lambda p: (weight[p], p))
    named = [t for t in best if t in ("article", "main")]
    container = best[: best.index(named[0]) + 1] if named else best[:-1] if len(best) > 1 else best

    def content(path: Path) -> bool:
        share = score[path] / score[best]
        inside = path[: len(container)] == container
        own = path[next((i for i, (x, y) in enumerate(zip(path, best)) if x != y), min(len(path), len(best))) :]
        other = [x for x in own if x[-1] in NAMES]
        if other:  # well marked as it may be, it is no more content than the best
            share = min(share, 1.0) * math.prod(SECTION if _tag(x) == "section" and inside and named else NAMES[x[-1]] for x in other)
        if not inside or other or _tag(container[-1] if container else "body") in ("html", "body") and unlinked[path] <= LINKS:
            return share * unlinked[path] >= (CLEAR if named and not inside else FUSED)
        beside = not named and path == container  # by its path it may as well stand in another element
        tags = {_tag(x) for x in own}
        return share >= FUSED or bool(SHAPES & tags) or not (beside or WRAPS & tags)

    chosen = {p: content(p) for p in times}
    keep = [chosen[p] for p, *_ in found]
    for i in range(len(found) - 2, -1, -1):  # a heading goes with what it stands above
        (path, *_), (after, *_) = found[i], found[i + 1]
        if path[-1:] and _tag(path[-1]) in HEADINGS and path[:-1] == after[: len(path) - 1] and path[: len(container)] == container:
            keep[i] = keep[i + 1]
    return "\n\n".join(t for (_, t, *_), k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
