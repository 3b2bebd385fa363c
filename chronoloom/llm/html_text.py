r"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features of a block and its neighbours.

A page is cut into flat blocks at block-level tags. Every block has its word count and link density, those of the blocks before
and after it, and three flags of the markup around it: inside an element for something other than the article (menus, footers,
forms, adverts, comments ...), inside or outside of an element that holds the article (or neither, if the page has none), and
heading. A small decision tree, grown by Gini impurity from the labelled table below, says which blocks are the article.
What a name says ends at a word such as "with" or "no" ("content-with-sidebar" is content). Forms and names of two meanings ("related", "dialog"
...) are settled by what they hold: a form around an article, or around half of the page's words, is no form; prose under such a name inside
the article is the article's. A run of links under a heading of its own stays unless the heading announces other pages.
Inside a block, references are decoded and white space becomes one space; the blocks kept are joined by line feeds in page order.

Defined results: a null or empty html, or a page without article blocks, gives an empty text; repeated rows are extracted row by
row; unclosed and truncated markup is read as far as it goes; an empty table gives no rows; other columns are carried unless
they clash with the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element and class names of HTML pages.
SILENT = "script|style|noscript|template|title|textarea|select|button|svg|iframe|object|canvas"
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section span table td ul".split())
OTHER_ELEMENTS = frozenset("aside dialog fieldset footer menu nav".split())
ARTICLE_ELEMENTS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dialog discussion disqus disclaimer footer form gdpr hidden login masthead menu menubar modal nav navbar navigation navigationbar newsletter notice notification pagination pager popup promo promoted promotion recommended related replies respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
ARTICLE_NAMES = frozenset("article articlebody content main maincontent post postbody entry story storybody".split())
HEADER_NAMES = frozenset("header siteheader pageheader".split())
#: Names that mean something else in an article's prose; words after which a name speaks of what is absent or beside it; headings of links to other pages.
TWO_MEANINGS = frozenset("dialog discussion form recommended related".split())
ASIDE_WORDS = frozenset("has hide no non not with without".split())
OTHER_HEADINGS = frozenset("also contents follow latest like more navigation newsletter next popular previous read recommended related share subscribe tags topics trending".split())

# Attributes up to the end of a tag: a quote opens a value only after "=", values have any length.
_ATTRS = r"(?:[^<>=/]++|/(?!>)|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<svg\b{_ATTRS}/>"
    rf"|<(?P<silent>{SILENT})\b(?:{_ATTRS}|[^>]*+)>.*?(?:</(?P=silent)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})(?P<void>/?)>"
    r"|<[a-zA-Z/!?][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>][^\s<>]*)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Attributes up to this length are remembered with what they say.
REMEMBERED = 500
_WORD = re.compile(r"[a-z0-9]+")

FEATURES = ("words", "link", "prev_words", "prev_link", "next_words", "next_link", "other", "scope", "heading")
#: Words, words a block and most link density of prose; link density of a block of links.
PROSE_WORDS, PROSE_BLOCK, PROSE_LINKS, ALL_LINKS = 20, 8, 0.3, 0.9
#: scope: the block stands outside of the page's article element, the page has none, inside of it.
OUTSIDE, NONE, INSIDE = 0, 1, 2

# Hand-labelled blocks, one a line: the features in order, then 1 for the article.
LABELLED = """
12 0 0 0 80 0 0 2 1 1|80 0 12 0 45 0 0 2 0 1|45 .05 80 0 6 0 0 2 0 1|6 0 45 .05 60 0 0 2 1 1|1 0 60 0 70 0 0 2 0 1|3 0 1 1 2 1 0 2 0 1
2 0 3 0 1 0 0 2 0 1|1 0 0 0 6 1 0 2 1 1|150 .1 40 0 0 0 0 2 0 1|25 .4 60 0 30 0 0 2 0 1|8 1 50 0 40 0 0 2 0 1|5 0 90 0 12 .1 0 2 0 1
14 0 2 1 9 0 0 2 0 1|30 0 1 0 1 0 0 2 0 1|9 0 8 0 8 0 0 2 0 1|4 1 30 0 25 0 0 2 0 1|200 0 12 0 150 0 0 2 0 1|60 .2 5 0 11 .1 0 2 1 1
1 1 0 0 1 1 1 0 0 0|1 1 1 1 1 1 1 0 0 0|2 1 1 1 9 0 1 0 0 0|9 0 1 1 12 0 1 0 0 0|11 .1 90 0 0 0 1 0 0 0|30 0 1 1 12 0 1 0 0 0
45 0 60 0 50 0 1 0 0 0|60 0 45 0 0 0 1 0 0 0|20 .3 70 0 80 0 1 2 0 0|50 0 70 0 80 0 1 2 0 0|4 0 80 0 6 0 1 2 1 0|2 1 90 0 3 1 1 2 0 0
35 0 3 0 40 0 1 2 0 0|120 0 10 0 80 0 1 2 0 0|7 0 20 0 7 0 1 1 0 0|40 0 7 0 45 0 1 1 0 0|1 1 1 1 1 1 1 1 0 0|90 0 80 0 3 1 1 1 0 0
3 0 0 0 1 1 0 0 0 0|8 0 1 1 12 0 0 0 1 0|12 0 5 0 80 0 0 0 0 0|15 .2 90 0 0 0 0 0 0 0|40 0 1 1 12 0 0 0 0 0|2 1 5 0 6 1 0 0 0 0
70 0 30 0 4 0 0 0 0 0|1 0 80 0 2 0 0 0 0 0|25 .8 60 0 5 1 0 0 0 0|100 .1 90 0 0 0 0 0 0 0|6 0 0 0 14 0 0 0 1 0|18 0 2 1 3 1 0 0 0 0
60 0 9 0 45 0 0 1 0 1|45 .05 60 0 70 0 0 1 0 1|90 .1 4 0 3 1 0 1 0 1|22 0 60 0 40 0 0 1 0 1|7 0 2 1 60 0 0 1 1 1|5 0 80 0 70 0 0 1 1 1
13 0 50 0 60 0 0 1 0 1|6 0 55 0 48 0 0 1 0 1|30 .2 40 0 10 0 0 1 0 1|18 0 22 0 35 0 0 1 0 1|9 .1 40 0 33 0 0 1 0 1|16 0 0 0 50 0 0 1 0 1
1 1 1 1 1 1 0 1 0 0|2 1 2 1 3 1 0 1 0 0|4 .5 1 1 2 1 0 1 0 0|12 .9 3 1 40 0 0 1 0 0|20 .8 40 0 5 1 0 1 0 0|3 0 1 1 2 1 0 1 0 0
5 0 2 1 4 1 0 1 0 0|9 .3 60 0 0 0 0 1 0 0|6 0 4 1 0 0 0 1 0 0|30 .9 2 1 30 .9 0 1 0 0|8 .6 50 0 45 0 0 1 0 0|4 0 3 0 2 0 0 1 0 0
4 0 112 0 20 0 0 2 0 1|7 .1 110 0 10 0 0 2 0 1|9 0 10 0 41 0 0 2 1 1|18 .4 42 0 6 0 0 2 0 1|41 0 110 0 11 0 0 2 0 1|111 .05 4 0 112 0 0 2 0 1
4 0 11 0 111 1 0 2 0 1|7 .1 18 0 10 1 0 2 0 1|9 0 41 0 110 1 0 2 1 1|19 .4 2 0 19 1 0 2 0 1|41 0 11 0 19 1 0 2 0 1|112 .05 111 0 5 1 0 2 0 1
2 0 19 1 20 0 0 2 0 1|7 .1 19 1 2 0 0 2 0 1|11 0 110 1 10 0 0 2 0 1|20 .4 3 1 9 0 0 2 0 1|42 0 40 1 41 0 0 2 0 1|110 .05 19 1 10 0 0 2 0 1
4 0 7 1 7 1 0 2 0 1|7 .1 4 1 3 1 0 2 0 1|10 0 40 1 2 1 0 2 0 1|20 .4 6 1 4 1 0 2 0 1|42 0 7 1 9 1 0 2 0 1|111 .05 4 1 3 1 0 2 0 1
3 1 19 0 4 0 0 2 0 1|7 1 112 0 3 0 0 2 1 1|15 1 9 0 4 0 0 2 0 1|30 1 40 0 6 0 0 2 0 1|4 1 112 .1 0 0 0 2 0 1|6 1 0 0 4 0 0 2 1 1
2 .9 5 0 110 1 0 2 0 0|2 1 4 1 6 0 0 2 0 0|2 1 9 1 10 1 0 2 0 0|5 .95 2 0 112 1 0 2 0 0|5 .9 10 1 112 0 0 2 0 0|5 .9 18 1 3 1 0 2 0 0
11 1 19 0 19 1 0 2 0 0|11 1 111 1 19 0 0 2 0 0|11 1 41 1 19 1 0 2 0 0|24 1 2 0 5 1 0 2 0 0|24 .95 110 1 19 0 0 2 0 0|24 .95 111 1 2 1 0 2 0 0
2 0 42 1 10 1 1 2 0 0|2 1 19 0 111 1 1 2 0 0|9 0 40 1 3 1 1 2 0 0|9 1 5 1 40 1 1 2 0 0|45 0 19 0 42 0 1 2 0 0|45 1 110 0 5 0 1 2 0 0
25 .6 44 0 18 0 0 2 0 1|12 .7 20 0 90 .1 0 2 0 1|40 .55 30 0 4 1 0 2 0 1|18 .6 3 1 50 0 0 2 0 1|33 .65 5 1 6 1 0 2 0 1|14 .8 60 0 40 0 0 2 0 1
9 .6 6 1 0 0 0 2 0 1|70 .5 2 1 3 1 0 2 0 1|11 .75 50 0 3 1 0 2 0 1|6 .55 4 0 3 1 0 2 0 1|5 .6 0 0 30 .6 0 2 0 1|21 .6 20 .6 25 .6 0 2 0 1
2 .1 3 0 2 0 0 2 0 1|5 .2 6 1 1 1 0 2 0 1|3 .3 40 0 2 0 0 2 0 1|1 0 2 1 3 1 0 2 0 1|6 .4 12 0 4 1 0 2 0 1|2 .3 0 0 1 0 0 2 1 1
6 0 40 0 33 0 0 1 0 1|3 0 25 0 60 0 0 1 0 1|8 0 18 0 12 0 0 1 0 1|2 0 50 0 22 0 0 1 0 1|5 0 70 0 8 0 0 1 0 1|4 0 9 0 30 0 0 1 0 1
7 0 14 0 28 0 0 1 0 1|4 0 33 0 16 0 0 1 0 1|1 0 45 0 40 0 0 1 0 1|8 0 60 0 35 0 0 1 0 1|3 0 12 0 20 0 0 1 0 1|6 0 28 0 7 0 0 1 0 1
20 0 0 0 0 0 0 1 0 1|9 0 0 0 0 0 0 1 0 1|20 0 60 0 0 0 0 1 0 1|14 0 45 0 0 0 0 1 0 1|12 0 50 0 4 .5 0 1 0 1|3 0 40 0 0 0 0 1 0 0
"""


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: float = 0.0


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    """A binary tree by Gini impurity; cuts lie half-way between neighbouring values, the first best one wins."""
    node = Node(value=float(y.mean()))
    if depth == 0 or node.value in (0.0, 1.0):
        return node
    best = len(y) * node.value * (1 - node.value) - 1e-12
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            a, b = y[low], y[~low]
            gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if gini < best and min(len(a), len(b)) >= least:
                best, node.feature, node.cut = gini, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow_tree(x[low], y[low], depth - 1, least), grow_tree(x[~low], y[~low], depth - 1, least)
    return node


def apply_tree(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low, out = x[:, node.feature] <= node.cut, np.empty(len(x))
    out[low], out[~low] = apply_tree(node.low, x[low]), apply_tree(node.high, x[~low])
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    table = np.array([[float(v) for v in row.split()] for line in LABELLED.strip().split("\n") for row in line.split("|")])
    return table[:, :-1], table[:, -1]


@lru_cache(maxsize=1)
def article_tree() -> Node:
    return grow_tree(*labelled_table())


@dataclass
class Region:
    """A container of two meanings: its blocks, and what settles it."""

    first: int
    form: bool
    inside: bool
    article: bool = False
    last: int = -1


@dataclass
class Blocks:
    texts: list[str] = field(default_factory=list)
    rows: list[tuple[int, float, int, int, int]] = field(default_factory=list)  # words, link density, other, inside, level of heading
    regions: list[Region] = field(default_factory=list)

    def settle(self) -> None:
        """Blocks of regions that are neither a form around the page's text nor prose of the article become other ones."""
        for r in self.regions:
            own = self.rows[r.first : r.last if r.last >= 0 else None]
            mine = [x for x in own if not x[2]]
            words, linked = sum(x[0] for x in mine), sum(x[0] * x[1] for x in mine)
            if r.form:
                good = r.article or (2 * words >= sum(x[0] for x in self.rows if not x[2]) and words >= PROSE_WORDS and linked < PROSE_LINKS * words)
            else:
                good = r.inside and words >= PROSE_WORDS and words >= PROSE_BLOCK * len(mine) and linked < PROSE_LINKS * words
            if not good:
                self.rows[r.first : r.first + len(own)] = [(*x[:2], 1, *x[3:]) for x in own]


def _names(value: str) -> set[str]:
    """Words of an attribute's names, each up to a word that turns the rest into what it isn't."""
    words: set[str] = set()
    for name in value.lower().split():
        for word in _WORD.findall(name):
            if word in ASIDE_WORDS:
                break
            words.add(word)
    return words


def _says(name: str, attrs: str) -> tuple[int, bool, bool]:
    """(not the article: 1, perhaps not: 2, or 0; the article; a header) by an element's name and attributes."""
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attrs):
        attribute, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attribute in ("class", "id", "role"):
            words |= _names(value)
        hidden = hidden or (attribute in ("hidden", "aria-hidden") and value.lower() != "false") or (attribute == "style" and bool(_UNSEEN.search(value)))
    named = words & OTHER_NAMES
    other = 1 if name in OTHER_ELEMENTS or named - TWO_MEANINGS or hidden else 2 if named or name == "form" else 0
    return other, not other and (name in ARTICLE_ELEMENTS or not words.isdisjoint(ARTICLE_NAMES)), name == "header" or not words.isdisjoint(HEADER_NAMES)


_remembered = lru_cache(maxsize=50_000)(_says)


def _about(name: str, attrs: str) -> tuple[int, bool, bool]:
    return (_remembered if len(attrs) <= REMEMBERED else _says)(name, attrs)


def cut_blocks(html: str) -> Blocks:
    """Flat blocks of a page. ``span`` elements count as containers only for their names."""
    out = Blocks()
    stack: list[tuple[str, int, int, Region | None]] = []  # open containers: name, other, inside, and the region that it opened
    other = inside = heading = 0  # other: 1 by a name, 2 by an element that is never the article
    seen_article = False
    text: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                n = said.count(" ") + 1
                links = len(" ".join(unescape(x) for x in linked).split()) if linked else 0
                out.texts.append(said)
                out.rows.append((n, min(1.0, links / n), int(other > 0), inside, heading))
            text.clear()
            linked.clear()

    at = 0
    for m in _TOKEN.finditer(html):
        start = m.start()
        if start > at:
            piece = html[at:start]
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        closing = m["close"] == "/"
        if name in BLOCKS:
            flush()
            in_link = False
            if name in HEADINGS:
                heading = 0 if closing else int(name[1])
            elif not closing:
                heading = 0
        elif name == "a":
            in_link = not closing
        if name in CONTAINERS:
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if name == "span" and stack[k][1:3] != (other, inside):
                            flush()
                        for *_, region in stack[k:]:
                            if region:
                                region.last = len(out.rows)
                        del stack[k:]
                        break
                other, inside = stack[-1][1:3] if stack else (0, 0)
            elif not m["void"]:
                is_other, is_article, is_header = _about(name, m["attrs"])
                region = None
                if is_other == 2 and name in BLOCKS:
                    region = Region(len(out.rows), name == "form", bool(inside))
                    out.regions.append(region)
                    is_other = 0
                elif is_article and not other:
                    for *_, around in stack:
                        if around:
                            around.article = True
                if name in ARTICLE_ELEMENTS and not is_other and not seen_article:
                    seen_article = True
                    other = 0 if other == 1 else other  # a wrapper's name (say "with-sidebar") doesn't hide the page's article
                own = 2 if name in OTHER_ELEMENTS else 1 if is_other or (is_header and not inside) else 0
                now = (max(own, other), 1 if inside or is_article else 0)
                if name == "span" and now != (other, inside):
                    flush()
                other, inside = now
                stack.append((name, other, inside, region))
    text.append(html[at:])
    flush()
    out.settle()
    return out


def features(pages: list[Blocks]) -> np.ndarray:
    """One row for each block of each page, in order."""
    rows = np.array([r for p in pages for r in p.rows], dtype=float).reshape(-1, 5)
    page = np.repeat(np.arange(len(pages)), [len(p.rows) for p in pages])
    x = np.zeros((len(rows), len(FEATURES)))
    x[:, 0:2], x[:, 6], x[:, 8] = rows[:, 0:2], rows[:, 2], rows[:, 4] > 0
    if len(rows):
        same = page[1:] == page[:-1]
        x[1:, 2:4] = rows[:-1, 0:2] * same[:, None]
        x[:-1, 4:6] = rows[1:, 0:2] * same[:, None]
        has = np.bincount(page, weights=rows[:, 3] * (1 - rows[:, 2]), minlength=len(pages)) > 0
        x[:, 7] = np.where(rows[:, 3] > 0, INSIDE, np.where(has[page], OUTSIDE, NONE))
    return x


def _under_headings(page: Blocks, kept: np.ndarray) -> None:
    """Keep runs of links of the article that stand under a heading of their own, below the title."""
    listed = False
    for k, (_, link, other, inside, heading) in enumerate(page.rows):
        if heading:
            listed = bool(kept[k]) and heading > 1 and OTHER_HEADINGS.isdisjoint(_WORD.findall(page.texts[k].lower()))
        elif listed and inside and not other and link >= ALL_LINKS:
            kept[k] = True
        else:
            listed = False


def extract_texts(htmls: list[str | None], tree: Node | None = None) -> list[str]:
    pages = [cut_blocks(h or "") for h in htmls]
    kept = apply_tree(tree or article_tree(), features(pages)) >= 0.5
    texts, at = [], 0
    for p in pages:
        _under_headings(p, kept[at : at + len(p.texts)])
        texts.append("\n".join(t for t, k in zip(p.texts, kept[at : at + len(p.texts)], strict=True) if k))
        at += len(p.texts)
    return texts


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages' other columns with ``text`` and ``n_chars``, its code points."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = StructType([*(pages.schema[c] for c in keep), StructField("text", StringType()), StructField("n_chars", LongType())])
    tree = article_tree()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = extract_texts(batch.column(html_col).to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, html_col).mapInArrow(apply, schema)
