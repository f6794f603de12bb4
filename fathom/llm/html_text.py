"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser is fed a page in pieces; its events cut the page into lines, one for each run of text
between block tags. A line knows its text, the tags inside it, how much of it is linked and its element. Text-to-tag
ratios of the lines are smoothed by a Gaussian and cut by a threshold from their spread; runs of lines above it are
the clusters, which say where the content is.

Some elements and roles are chrome for sure (menus, forms, footers and the like). Classes and ids are evidence of two
strengths: a name made of layout words only (`cookie-notice`, `post-comments`) marks chrome unless all of the clusters
lie inside it, which makes it the page's layout; other names with such a word (`ad-hoc`, `share-of-gdp`, an id that can
be a section's subject) only do if the element is built like chrome: mostly links, controls inside, or out of every
cluster and of every article.

The heaviest main element, or the articles of the parent whose articles are the heaviest, hold the content; without
them the element with nearly all of the clusters and what lies around it, but for blocks that are mostly links. All lines
there that are no chrome are content, short ones too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements of HTML by what they mean for the text.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
HIDDEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "math", "title"}
CHROME = {"nav", "footer", "aside", "form", "menu", "button", "select", "textarea", "input", "label", "dialog", "fieldset", "option", "datalist"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "note"}
# Words of classes and ids. Those that only chrome is named by; those that a section's subject can be named
# by as well; those that count outside of articles only; those that always need evidence; those that only say where or
# in what shape.
CHROME_WORDS = {
    "comment", "comments", "commentlist", "disqus", "respond", "recirc", "newsletter", "subscribe", "signup", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "popup", "modal", "pagination", "pager",
    "breadcrumb", "breadcrumbs", "nav", "navbar", "navigation", "menu", "sidebar", "login",
}
SUBJECT_WORDS = {"related", "recommended", "share", "sharing", "social", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices"}
OUTER_WORDS = {"header", "masthead", "footer", "side", "aside", "banner", "overlay", "search", "widget", "toolbar", "skip", "alert", "copyright", "legal", "topbar"}
WEAK_WORDS = {"discussion", "reply", "replies"}
PLACE_WORDS = {
    "list", "box", "container", "wrapper", "wrap", "bar", "block", "section", "area", "unit", "slot", "links", "link", "buttons", "button", "icons", "items", "item", "posts", "post", "articles", "article", "stories",
    "form", "main", "top", "bottom", "left", "right", "inner", "outer", "site", "page", "entry", "global", "primary", "secondary", "mobile", "desktop", "sticky", "panel", "row", "col", "column", "content", "text", "body",
    "user", "reader", "news", "media", "header", "footer", "title", "group", "module", "component", "large", "small", "banner", "widget", "policy", "bottombar", "threads", "thread",
}
#: Words that say an element goes without or beside what follows, such as has-sidebar.
BESIDE_WORDS = {"has", "no", "with", "without", "is", "not"}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements that end an open element of the same kind: the end tag may be left out.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSES = {tag: [name for name, by in CLOSED_BY.items() if tag in by] for by in CLOSED_BY.values() for tag in by}
#: Elements past which a missing end tag is not looked for.
SCOPES = {"table", "td", "th", "article", "section", "div", "body", "html", "ul", "ol", "dl", "main", "aside", "nav", "footer", "header", "form", "blockquote"}
#: Elements that hold the content, and those in which a header is not the page's.
CONTAINERS, SECTIONS = {"article", "main"}, {"article", "main", "section"}
#: Elements whose ids are anchors of their text.
ANCHORED = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "table", "figure", "figcaption", "a", "span", "article", "main"}
CONTROLS = {"button", "input", "textarea", "select", "form"}
#: Width of the Gaussian in lines, what part of the spread the threshold takes, and characters fed at once.
SIGMA, SPREAD, PIECE = 1.0, 0.5, 1 << 16
#: Part of a block's characters that are in links from which it is built like a menu; part of the clusters that is at the core.
LINKED, CORE = 0.5, 0.9
_WHITE = re.compile(r"\s+")
_OWNER = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


@lru_cache(maxsize=4096)
def evidence(classes: str, ids: str, inside: bool) -> int:
    """How much a class and id say that an element is chrome: 2 is a mark, 1 a hint."""
    known = CHROME_WORDS | SUBJECT_WORDS | (set() if inside else OUTER_WORDS)
    found = 0
    for tokens, anchor in ((classes, False), (ids, True)):
        for token in tokens.split():
            parts = [p.lower() for p in _PARTS.findall(token)]
            if not set(parts) & (known | WEAK_WORDS) or set(parts) & BESIDE_WORDS:
                continue
            layout = all(p in known or p in WEAK_WORDS or p in PLACE_WORDS or p.isdigit() for p in parts)
            subject = len(parts) == 1 and (parts[0] in WEAK_WORDS or (anchor and parts[0] in SUBJECT_WORDS))
            found = max(found, 2 if layout and not subject else 1)
    return found


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    node: int
    heading: bool


class Open(NamedTuple):
    """An open element: its name, the nearest kept element, whether it is chrome for sure, hidden, in a section, in an article or main, a link, in a heading."""

    name: str = ""
    node: int = 0
    chrome: bool = False
    hidden: bool = False
    section: bool = False
    inside: bool = False
    link: bool = False
    heading: bool = False


class Lines(HTMLParser):
    """Cuts a page into lines and keeps the elements that they are in, each after its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # of each kept element: its name, parent, evidence of chrome, controls inside
        self.names, self.parents, self.marks, self.controls = ["html"], [0], [0], [0]
        self.open: list[Open] = []
        self.opened: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.links = self.linked = 0

    def end_line(self) -> None:
        text = _WHITE.sub(" ", "".join(self.text)).strip()
        now = self.open[-1] if self.open else Open()
        if text and not now.hidden and not now.chrome:
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), now.node, now.heading))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in HIDDEN:
            self.end_line()
        if any(self.opened[x] for x in CLOSES.get(tag, ())):
            for k in range(len(self.open) - 1, -1, -1):
                name = self.open[k].name
                if tag in CLOSED_BY.get(name, ()):
                    self._close(k)
                    break
                if name in SCOPES:
                    break
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        above = self.open[-1] if self.open else Open()
        node = above.node
        if tag in CONTROLS:
            self.controls[node] += 1
        if tag in VOID:
            return
        own = dict(attrs)
        role = (own.get("role") or "").lower()
        kind = role if role in CONTAINERS else tag
        sure = tag in CHROME or (tag == "header" and not above.section) or role in CHROME_ROLES
        mark = 0
        if not sure and tag not in ("html", "body") and kind not in CONTAINERS:
            mark = evidence(own.get("class") or "", "" if tag in ANCHORED else own.get("id") or "", above.inside)
        if tag in BLOCKS or mark or kind in CONTAINERS:
            if tag not in BLOCKS:
                self.end_line()
            self.names.append(kind)
            self.parents.append(node)
            self.marks.append(mark)
            self.controls.append(0)
            node = len(self.names) - 1
        elif sure and not above.chrome and tag not in HIDDEN:
            self.end_line()
        away = tag in HIDDEN or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "").lower()
        link = tag == "a" and "href" in own
        self.links += link
        self.opened[tag] += 1
        self.open.append(Open(tag, node, sure or above.chrome, away or above.hidden, above.section or kind in SECTIONS, above.inside or kind in CONTAINERS, link, above.heading or tag in HEADINGS))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.opened[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].name
            if name == tag:
                above = self.open[k - 1] if k else Open()
                if tag in BLOCKS or tag in HIDDEN or self.open[-1][1:4] != above[1:4]:
                    self.end_line()
                self._close(k)
                return
            if name in SCOPES and tag not in SCOPES:
                return

    def _close(self, k: int) -> None:
        self.links -= sum(x.link for x in self.open[k:])
        self.opened.subtract(x.name for x in self.open[k:])
        del self.open[k:]

    def handle_data(self, data):
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.end_line()


def lines_of(html: str) -> Lines:
    parser = Lines()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    return parser


def clusters(ratios: np.ndarray, sigma: float = SIGMA, spread: float = SPREAD) -> np.ndarray:
    """Which lines have a smoothed ratio of at least the threshold: spread times the ratios' standard deviation, or their mean if that is less."""
    if not len(ratios):
        return np.zeros(0, bool)
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    return smooth >= min(spread * ratios.std(), ratios.mean())


def _ratios(lines: list[Line]) -> np.ndarray:
    return np.array([len(x.text) / (1 + x.tags) for x in lines])


class Page:
    """The elements of a page with sums over the lines in them."""

    def __init__(self, parser: Lines, lines: list[Line]) -> None:
        self.names, self.parents, self.lines = parser.names, parser.parents, lines
        self.inside = clusters(_ratios(lines))
        n = len(self.names)
        self.chars, self.linked, self.weight, self.controls = [0] * n, [0] * n, [0] * n, list(parser.controls)
        for line, inside in zip(lines, self.inside):
            self.chars[line.node] += len(line.text)
            self.linked[line.node] += line.linked
            self.weight[line.node] += len(line.text) * bool(inside)
        # the outermost main or article around each element, or 0
        self.top = [0] * n
        for k in range(1, n):
            self.top[k] = self.top[self.parents[k]] or (k if self.names[k] in CONTAINERS else 0)
        self.holds = [k > 0 and self.top[k] == k for k in range(n)]
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            for sums in (self.chars, self.linked, self.weight, self.controls):
                sums[up] += sums[k]
            self.holds[up] = self.holds[up] or self.holds[k]

    def menu_like(self, node: int) -> bool:
        return self.linked[node] >= LINKED * self.chars[node] > 0

    def below(self, around: set[int]) -> list[int]:
        """For each element the one right below the innermost of `around` (a path from the page down) that it is in; 0 for those around."""
        out = [0] * len(self.names)
        for k in range(1, len(out)):
            if k not in around:
                out[k] = out[self.parents[k]] or k
        return out

    def inside_of(self, node: int) -> list[bool]:
        out = [k == node for k in range(len(self.names))]
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parents[k]]
        return out

    def path(self, node: int) -> set[int]:
        """An element and all that it is in."""
        out = {node, 0}
        while node:
            node = self.parents[node]
            out.add(node)
        return out

    def without_marked(self, marks: list[int]) -> list[Line]:
        """The lines that are in no element that its class or id shows to be chrome."""
        gone = [False] * len(marks)
        total = self.weight[0]
        for k in range(1, len(marks)):
            gone[k] = gone[self.parents[k]]
            if not marks[k] or gone[k] or (self.holds[k] and self.top[k] in (0, k)):
                continue
            if marks[k] == 2:
                # what holds every cluster is the layout
                gone[k] = not total or self.weight[k] < total or self.top[k] > 0
            else:
                gone[k] = self.menu_like(k) or self.controls[k] > 0 or (not self.top[k] and not self.weight[k])
        return [x for x in self.lines if not gone[x.node]]

    def content(self) -> list[Line]:
        tops: dict[int, int] = {}
        for k, name in enumerate(self.names):
            if k and self.top[k] == k and self.chars[k]:
                group = k if name == "main" else -self.parents[k]
                tops[group] = tops.get(group, 0) + 1 + self.weight[k]
        if not tops:
            return self._around()
        best = max(tops, key=lambda g: (tops[g], g))
        if best > 0:
            return [x for x in self.lines if self.top[x.node] == best]
        return self._articles(-best)

    def _articles(self, parent: int) -> list[Line]:
        """The articles of one parent, what lies between them, and a heading before them if they have none of their own."""
        own = [self.names[t] == "article" and self.parents[t] == parent if (t := self.top[x.node]) else False for x in self.lines]
        at = [i for i, x in enumerate(own) if x]
        blocks, within = self.below(self.path(parent)), self.inside_of(parent)
        between = [within[x.node] and not self.top[x.node] for x in self.lines]
        first = at[0]
        if not any(self.lines[i].heading for i in at if self.top[self.lines[i].node] == self.top[self.lines[first].node]):
            heads = [i for i in range(first) if between[i] and self.lines[i].heading]
            first = heads[-1] if heads else first
        return [x for i, x in enumerate(self.lines) if own[i] or (first <= i < at[-1] and between[i] and not self._apart(x, blocks[x.node]))]

    def _apart(self, line: Line, block: int) -> bool:
        """Whether a line, or the block that it is in, is mostly links, or names an owner of rights."""
        linked = self.menu_like(block) if block else line.linked >= LINKED * len(line.text)
        return linked or bool(_OWNER.match(line.text))

    def _around(self) -> list[Line]:
        """All lines, but outside of the innermost element that holds nearly all of the clusters no block of links."""
        core = max((k for k in range(len(self.names)) if self.weight[k] >= CORE * self.weight[0]), default=0)
        path = self.path(core)
        blocks, inside = self.below(path), self.inside_of(core)
        return [x for x in self.lines if inside[x.node] or not self._apart(x, blocks[x.node])]


def main_text(html: str | None) -> str:
    """The page's content, blocks joined by empty lines; empty if it has none."""
    parser = lines_of(html or "")
    if not parser.lines:
        return ""
    lines = Page(parser, parser.lines).without_marked(parser.marks)
    return "\n\n".join(x.text for x in Page(parser, lines).content()) if lines else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages have an empty text, an empty table an empty result. Pages of any length are parsed whole, in
    pieces; rows that repeat an id or a page are parsed each, in no order; other columns are ignored, so their names
    cannot clash.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x.as_py()) for x in part.column(2)], pa.string())], ["page_id", "url", "text"])

    done = own.mapInArrow(run, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
