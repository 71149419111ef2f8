"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its own word
count and link density, those of its neighbours, and where it stands: inside, outside or
without an article element (one that holds little of a page's running text counts for
nothing), as a heading, and inside a container that is a menu, footer, advert, comment list
and so on by its element or its whole name (2), or has such a word among others in its name
(1), of which only words and links can tell whether it is text. A decision tree, grown on
the small labelled table below, says which blocks are main text; their texts are joined in
page order.

Scripts, styles, the head, hidden elements, form controls and comments never yield blocks.
Character references are decoded piece by piece, so markup between the parts of one is
never joined into another.

Defined results: null and empty pages give an empty text; markup that is cut off at the end
is dropped; end tags without a start are passed over; repeated pages give equal texts;
other columns, whatever their names, are not read.

Scale: one narrow pass over whole pages; nothing is collected or broadcast but the tree.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACE = {"br", "td", "th", "img", "wbr"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"head", "template", "svg", "annotation", "annotation-xml", "select", "button", "object", "audio", "video", "canvas", "map", "datalist", "label", "output"}
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset", "dir"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note", "status"}
#: Words of class and id names by which containers call themselves something other than text.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsors affiliate"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar masthead header footer foot colophon copyright"
    " sidebar side aside rail widget widgets related recommended recommendations trending popular"
    " comment comments commentlist respond reply replies discussion disqus feedback review reviews"
    " cookie cookies consent gdpr notice notices notification notifications alert warning disclaimer popup modal overlay lightbox"
    " share sharing social follow subscribe subscription newsletter signup login register search searchbox form pager pagination"
    " skip tags taglist tagcloud legal".split()
)
#: Of those, the words that layouts also give to a wrapper around the text itself.
LAYOUT = set("nav navbar menu menubar topbar toolbar header side sidebar rail banner overlay search widget".split())
#: Of those, the words that say so in any company: "comment-text" is no text, "review-text" may be.
CLEAR = set(
    "advert adverts advertisement advertising adsense sponsored navbar breadcrumb breadcrumbs footer sidebar"
    " comment comments commentlist reply replies disqus gdpr newsletter pager pagination taglist tagcloud searchbox".split()
)
#: Words that say nothing of what a container holds.
NEUTRAL = set(
    "list lists item items box boxes container wrapper wrap bar section block inner outer site page button buttons link links post posts area zone slot unit"
    " top bottom left right center primary secondary main global fixed sticky mobile desktop col column row grid group panel strip google cookie policy us".split()
)
_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)|[!?][^>]*(?:>|\Z)|/[^A-Za-z][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A flat block: its text, and what the tree looks at."""

    text: str
    words: int
    linked: int
    boiler: int
    hard: int  # boiler without the names of layouts
    article: int  # 1 inside an article, -1 outside of the page's article, 0 on a page without
    heading: bool


@dataclass
class _Open:
    tag: str
    boiler: int
    hard: int
    article: bool
    hidden: bool


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    linked: int = 0
    heading: bool = False
    has_article: bool = False

    def text(self, raw: str) -> None:
        if self.stack and self.stack[-1].hidden:
            return
        if "&" in raw:
            raw = _html.unescape(raw)
        self.pieces.append(raw)
        if self.links:
            self.linked += len(raw.split())

    def close(self) -> None:
        """End the block at hand."""
        if self.pieces:
            words = "".join(self.pieces).split()
            if words:
                top = self.stack[-1] if self.stack else None
                self.blocks.append(Block(" ".join(words), len(words), min(self.linked, len(words)), top.boiler if top else 0, top.hard if top else 0, int(bool(top and top.article)), self.heading))
            self.pieces = []
        self.linked = 0

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.close()
            if self.stack and self.stack[-1].tag == "p":
                self.stack.pop()  # a paragraph ends where the next block begins
            if tag == "li":
                self._end_open("li", ("ul", "ol", "menu"))
            self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif tag in SPACE:
            self.pieces.append(" ")
        if tag == "a":
            self.links = 1
        if tag in VOID or not (tag in BLOCK or tag in DROPPED or "class" in attrs or "id" in attrs or "hidden" in attrs or "style" in attrs):
            return
        top = self.stack[-1] if self.stack else _Open("", 0, 0, False, False)
        boiler, hard, article, hidden = top.boiler, top.hard, top.article, top.hidden or tag in DROPPED
        named = _says(attrs) if attrs and tag not in ("html", "body") else (0, 0, False)
        if tag in ("article", "main"):
            # a text's own element stands for text, whatever the layout around it is called
            self.has_article = article = True
            boiler = hard = max(hard, named[1])
        else:
            boiler, hard = max(boiler, named[0]), max(hard, named[1])
        if tag in BOILER or tag == "header" and not article:
            boiler = hard = 2
        self.stack.append(_Open(tag, boiler, hard, article, hidden or named[2]))

    def _end_open(self, tag: str, stop: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in stop:
                return

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.close()
            self.heading = False
        elif tag in SPACE:
            self.pieces.append(" ")
        if tag == "a":
            self.links = 0
        if any(o.tag == tag for o in self.stack):
            # an inline element's end doesn't close blocks opened inside it
            if tag in BLOCK or tag in DROPPED or self.stack[-1].tag == tag:
                while self.stack.pop().tag != tag:
                    pass


def _says(attrs: str) -> tuple[int, int, bool]:
    """How far attributes name a container of something other than text (0, 1, 2), the same without layouts' words, and whether they hide it."""
    named = hard = 0
    hidden = False
    low = attrs.lower()
    if "hidden" in low:
        hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", low))) or 'aria-hidden="true"' in low
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _NAME.findall(token)}
                for found, rest in ((words & NAMES, words - NAMES), (words & NAMES - LAYOUT, words - NAMES)):
                    level = 0 if not found else 2 if found & CLEAR or not rest - NEUTRAL else 1
                    if found & LAYOUT:
                        named = max(named, level)
                    elif found:
                        named, hard = max(named, level), max(hard, level)
        elif name == "role" and value.lower() in ROLES:
            named = hard = 2
        elif name == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
    return named, hard, hidden


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    state, at, n = _Page(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            state.text(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a lone < is text
            state.text(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            state.text(page[at:lt])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attrs = m[3]
        if attrs and (attrs.count('"') % 2 or attrs.count("'") % 2 and '"' not in attrs):
            # a > inside a quoted value: the tag ends behind the closing quote
            quote = page.find('"' if attrs.count('"') % 2 else "'", at)
            gt = page.find(">", quote) if quote >= 0 else -1
            if gt >= 0 and "<" not in page[at:quote]:
                attrs, at = page[m.start(3) : gt], gt + 1
        if m[4] == "" and at >= n and not page.endswith(">"):
            break  # cut off inside a tag
        if m[1]:
            state.end(tag)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        state.start(tag, attrs)
    state.close()
    running = [b for b in state.blocks if b.boiler < 2 and b.words >= 10 and 3 * b.linked < b.words]
    inside = sum(b.words for b in running if b.article)
    outside = sum(b.words for b in running if not b.article)
    teaser = outside >= 40 and outside > 2 * inside  # articles that hold little of the text
    for b in state.blocks:
        b.article = -b.article if teaser else b.article if b.article else -int(state.has_article)
    return state.blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row per block: own words and link density, the neighbours', container, article, heading."""
    words = np.array([0, *[b.words for b in blocks], 0], dtype=np.float64)
    linked = np.array([0, *[b.linked for b in blocks], 0], dtype=np.float64)
    dense = linked / np.maximum(words, 1)
    own = np.array([[b.boiler, b.article, b.heading] for b in blocks], dtype=np.float64).reshape(-1, 3)
    return np.column_stack([words[1:-1], dense[1:-1], words[:-2], dense[:-2], words[2:], dense[2:], own])


COLUMNS = ["words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article", "heading"]
#: The labelled table: the columns above, then whether the block is main text.
LABELLED = [
    # in an article: paragraphs, short ones, headings, a lone paragraph, links in running text
    (80, 0.0, 9, 0.0, 60, 0.0, 0, 1, 0, 1), (120, 0.05, 80, 0.0, 45, 0.0, 0, 1, 0, 1), (1, 0.0, 30, 0.0, 70, 0.0, 0, 1, 0, 1),
    (2, 0.0, 1, 0.0, 3, 0.0, 0, 1, 0, 1), (9, 0.0, 12, 0.0, 25, 0.0, 0, 1, 1, 1), (6, 0.0, 5, 1.0, 300, 0.0, 0, 1, 1, 1),
    (300, 0.01, 8, 0.0, 10, 0.0, 0, 1, 0, 1), (25, 0.1, 6, 1.0, 12, 0.0, 0, 1, 0, 1), (4, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 1),
    (12, 0.3, 60, 0.0, 50, 0.0, 0, 1, 0, 1), (1, 0.0, 1, 1.0, 1, 0.0, 0, 1, 0, 1), (3, 0.0, 7, 0.0, 6, 0.3, 0, 1, 0, 1),
    (7, 0.4, 20, 0.0, 20, 0.0, 0, 1, 0, 1), (15, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (5, 0.0, 90, 0.0, 4, 1.0, 0, 1, 0, 1),
    # in an article, next to links: text stays text, and so does a paragraph that is mostly a link
    (60, 0.0, 12, 0.8, 0, 0.0, 0, 1, 0, 1), (40, 0.0, 9, 0.9, 30, 0.0, 0, 1, 0, 1), (90, 0.1, 3, 1.0, 4, 1.0, 0, 1, 0, 1), (70, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 1),
    (8, 0.0, 4, 1.0, 3, 1.0, 0, 1, 0, 1), (2, 0.0, 3, 1.0, 5, 1.0, 0, 1, 0, 1), (14, 0.8, 0, 0.0, 60, 0.0, 0, 1, 0, 1), (10, 0.7, 6, 0.0, 80, 0.0, 0, 1, 0, 1),
    (22, 0.85, 30, 0.0, 40, 0.0, 0, 1, 0, 1), (6, 0.6, 25, 0.0, 30, 0.0, 0, 1, 0, 1), (30, 0.75, 20, 0.0, 0, 0.0, 0, 1, 0, 1), (8, 0.75, 0, 0.0, 45, 0.0, 0, 1, 0, 1),
    (11, 0.91, 0, 0.0, 60, 0.0, 0, 1, 0, 1), (21, 0.95, 30, 0.0, 25, 0.0, 0, 1, 0, 1), (16, 0.94, 8, 0.0, 35, 0.0, 0, 1, 0, 1), (30, 0.97, 12, 0.0, 50, 0.0, 0, 1, 0, 1),
    # in an article, but link lists: previous and next, tags, more stories
    (4, 1.0, 60, 0.0, 4, 1.0, 0, 1, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0, 0), (9, 1.0, 5, 1.0, 8, 1.0, 0, 1, 0, 0), (3, 1.0, 80, 0.0, 0, 0.0, 0, 1, 0, 0),
    (1, 1.0, 40, 0.0, 1, 1.0, 0, 1, 0, 0), (12, 1.0, 0, 0.0, 10, 1.0, 0, 1, 0, 0), (5, 1.0, 0, 0.0, 60, 0.0, 0, 1, 0, 0), (7, 1.0, 30, 0.0, 20, 0.0, 0, 1, 0, 0),
    # in containers that are something else, also inside an article, whatever their words
    (1, 1.0, 0, 0.0, 1, 1.0, 2, -1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, -1, 0, 0), (12, 0.0, 1, 1.0, 9, 0.0, 2, -1, 0, 0),
    (60, 0.0, 20, 0.0, 45, 0.0, 2, -1, 0, 0), (90, 0.0, 60, 0.0, 30, 0.0, 2, 1, 0, 0), (8, 0.2, 60, 0.0, 0, 0.0, 2, -1, 0, 0),
    (25, 0.0, 40, 0.0, 20, 0.0, 2, 1, 0, 0), (5, 0.0, 80, 0.0, 35, 0.0, 2, 1, 1, 0), (40, 0.1, 0, 0.0, 3, 1.0, 2, 0, 0, 0),
    (70, 0.0, 3, 0.0, 90, 0.0, 2, 0, 0, 0), (4, 0.0, 50, 0.0, 2, 0.0, 2, 0, 1, 0), (150, 0.0, 90, 0.0, 90, 0.0, 2, 0, 0, 0), (200, 0.0, 3, 0.0, 3, 0.0, 2, 1, 0, 0),
    (30, 0.0, 0, 0.0, 0, 0.0, 2, 0, 0, 0), (12, 0.0, 30, 0.0, 35, 0.0, 2, 0, 0, 0), (16, 0.0, 60, 0.0, 50, 0.0, 2, 1, 0, 0), (45, 0.0, 40, 0.0, 60, 0.0, 2, 0, 0, 0),
    (2, 0.0, 3, 0.0, 8, 0.0, 2, 1, 0, 0), (9, 0.0, 100, 0.0, 90, 0.0, 2, 1, 0, 0), (35, 0.0, 7, 0.0, 0, 0.0, 2, 1, 0, 0), (100, 0.0, 0, 0.0, 8, 0.0, 2, 1, 0, 0),
    # in containers with such a word among others in their name: paragraphs and their headings are text
    (60, 0.0, 6, 0.0, 50, 0.0, 1, 0, 0, 1), (35, 0.05, 60, 0.0, 0, 0.0, 1, 0, 0, 1), (80, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (40, 0.0, 5, 0.0, 70, 0.0, 1, 1, 0, 1),
    (120, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 1), (25, 0.1, 40, 0.0, 30, 0.0, 1, 1, 0, 1), (6, 0.0, 2, 1.0, 70, 0.0, 1, 0, 1, 1), (5, 0.0, 0, 0.0, 40, 0.0, 1, 1, 1, 1),
    (14, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0, 1), (18, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1), (30, 0.0, 1, 1.0, 45, 0.0, 1, 0, 0, 1), (50, 0.0, 4, 1.0, 3, 1.0, 1, 0, 0, 1),
    (7, 0.0, 45, 0.0, 60, 0.0, 1, 0, 1, 1), (12, 0.0, 30, 0.0, 40, 0.0, 1, 0, 0, 1), (22, 0.0, 0, 0.0, 55, 0.0, 1, 0, 0, 1), (28, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 1),
    (3, 0.0, 0, 0.0, 60, 0.0, 1, 1, 1, 1), (2, 0.0, 1, 1.0, 80, 0.0, 1, 0, 1, 1), (4, 0.0, 0, 0.0, 35, 0.0, 1, 1, 1, 1), (1, 0.0, 50, 0.0, 70, 0.0, 1, 0, 1, 1), (3, 0.0, 40, 0.0, 50, 0.0, 1, 1, 1, 1), (2, 0.0, 0, 0.0, 60, 0.0, 1, 0, 1, 1),
    # and their labels, links and lone lines are not
    (2, 0.0, 0, 0.0, 3, 1.0, 1, 0, 1, 0), (3, 1.0, 2, 0.0, 4, 1.0, 1, 0, 0, 0), (8, 0.9, 5, 1.0, 9, 1.0, 1, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 0.0, 1, 0, 0, 0),
    (6, 0.0, 8, 0.0, 4, 0.0, 1, -1, 0, 0), (10, 0.5, 3, 1.0, 6, 0.8, 1, 1, 0, 0), (2, 0.0, 80, 0.0, 3, 1.0, 1, 1, 0, 0), (5, 0.0, 4, 0.0, 6, 0.0, 1, 1, 0, 0),
    (20, 0.7, 12, 0.8, 15, 0.9, 1, 0, 0, 0), (15, 0.0, 3, 0.0, 2, 0.0, 1, -1, 0, 0), (3, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0), (40, 0.0, 5, 0.0, 6, 0.0, 1, -1, 0, 0),
    (3, 0.0, 60, 0.0, 5, 1.0, 1, 0, 1, 0), (2, 0.0, 0, 0.0, 4, 0.0, 1, 1, 1, 0), (4, 0.0, 50, 0.0, 6, 0.9, 1, 1, 1, 0),
    # outside of the page's article
    (10, 0.0, 1, 1.0, 8, 0.0, 0, -1, 0, 0), (45, 0.0, 5, 1.0, 7, 0.0, 0, -1, 0, 0), (6, 0.5, 70, 0.0, 4, 0.5, 0, -1, 0, 0),
    (90, 0.0, 4, 0.0, 30, 0.0, 0, -1, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, -1, 1, 0), (20, 0.0, 120, 0.0, 0, 0.0, 0, -1, 0, 0),
    (14, 0.0, 40, 0.0, 60, 0.0, 0, -1, 0, 0), (60, 0.0, 50, 0.0, 70, 0.0, 0, -1, 0, 0), (30, 0.0, 0, 0.0, 0, 0.0, 0, -1, 0, 0),
    # pages without an article element: text by its length and its neighbours
    (60, 0.0, 8, 0.0, 80, 0.0, 0, 0, 0, 1), (35, 0.1, 60, 0.0, 40, 0.0, 0, 0, 0, 1), (18, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 1), (5, 0.0, 45, 0.0, 70, 0.0, 0, 0, 1, 1), (6, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 1),
    (200, 0.0, 1, 1.0, 4, 1.0, 0, 0, 0, 1), (22, 0.0, 30, 0.0, 5, 1.0, 0, 0, 0, 1), (14, 0.0, 25, 0.0, 3, 0.0, 0, 0, 0, 1), (9, 0.1, 30, 0.0, 35, 0.1, 0, 0, 0, 1),
    (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (4, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 1),
    (50, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 1), (30, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0, 1), (16, 0.7, 0, 0.0, 60, 0.0, 0, 0, 0, 1), (25, 0.2, 1, 1.0, 0, 0.0, 0, 0, 0, 1),
    # and what surrounds it there
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0), (5, 0.8, 60, 0.0, 4, 1.0, 0, 0, 0, 0),
    (6, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1, 0), (20, 0.9, 5, 1.0, 8, 1.0, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (30, 0.7, 6, 1.0, 10, 0.5, 0, 0, 0, 0), (7, 0.1, 4, 1.0, 5, 0.9, 0, 0, 0, 0), (5, 0.0, 6, 0.9, 0, 0.0, 0, 0, 0, 0),
]


@dataclass
class Node:
    """A split (column, cut) with two children, or a leaf."""

    value: bool
    column: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Node:
    """A classification tree by Gini impurity; ties go to the first column and the lowest cut."""
    node = Node(bool(y.mean() >= 0.5))
    if depth == 0 or len(set(y.tolist())) < 2:
        return node
    gini = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = (gini(y) - 1e-9, -1, 0.0)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= cut
            if low.sum() >= least and (~low).sum() >= least and (g := gini(y[low]) + gini(y[~low])) < best[0] - 1e-12:
                best = (g, c, float(cut))
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        node.column, node.cut = best[1], best[2]
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def default_tree() -> Node:
    table = np.array(LABELLED, dtype=np.float64)
    return grow(table[:, :-1], table[:, -1])


def classify(tree: Node, row) -> bool:
    while tree.column >= 0:
        tree = tree.low if row[tree.column] <= tree.cut else tree.high
    return tree.value


def main_text(page: str | None, tree: Node) -> str:
    """The main text of a page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    chosen = [b.text for b, r in zip(blocks, block_features(blocks).tolist(), strict=True) if classify(tree, r)]
    if not chosen and any(b.boiler > b.hard for b in blocks):
        # all text stands in wrappers that are named after their layout: judge it without those names
        for b in blocks:
            b.boiler = b.hard
        chosen = [b.text for b, r in zip(blocks, block_features(blocks).tolist(), strict=True) if classify(tree, r)]
    return "\n\n".join(chosen)


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t, tree) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pick(pages, [(page_col, "page_id"), (url_col, "url"), (html_col, "html")]).mapInArrow(run, "page_id long, url string, text string, n_chars long")
