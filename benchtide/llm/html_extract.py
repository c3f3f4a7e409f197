"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams tags and text; every block element begins a new line, and each line has the
number of its characters per tag. The ratios of all lines of the page, menus and footers too, are smoothed with a Gaussian
over neighbouring lines, and a threshold splits them into clusters of running text and the rest; lines at a cluster's ends
that only their neighbours lift above the threshold are cut off. The clusters select the
region: the innermost element that holds all of them, or the innermost article or main around it. What stands there is kept
whole, short lines too. Where only the page's body holds all clusters, the region reaches from the first to the last line
of running text. A region without a first-level heading begins at the last one before it, with what stands between, such
as a byline. Outside article and main it also goes on, before and after, over paragraphs and list items beside it, up to
the next part or the next line that is all links: short first and last paragraphs are the article's.

Roles of elements only take out what is never the article, and clusters there select nothing: nav, aside, footer, form,
menu, dialog, a header outside an article, what is hidden, ARIA roles of such parts, and containers (not headings,
paragraphs, list items or cells) one of whose classes or whose id consists of words for such parts and words that say
nothing, as in `related-posts`, but not `related-work`. In an article or main a single word that may also name something
of the article's own (SOFT: a recipe's `menu`, `related`) takes its element out only where that holds no running
text, is no list, or is mostly links.

Defined results: a null or empty page, or one without text, gives an empty text of 0 code points. Broken markup is read
as far as the parser gets through it, which it always does. Repeated rows give repeated rows. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg iframe object canvas audio video textarea select option datalist".split())
OUTSIDE = frozenset("nav aside footer form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = frozenset("article main section div td body".split())
#: Elements whose classes and id are looked at.
CONTAINERS = frozenset("div section ul ol dl table span ins header center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words for parts that are not the article; words for its edges, which count outside articles only; words that say nothing.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion sidebar aside rail widget widgets menu menus nav navbar navigation navigationbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal modals overlay "
    "newsletter newsletters subscribe subscription signup login share sharing social related recommend recommended recommendations comment comments reply replies respond disqus discussion pagination pager toolbar search skip form".split()
)
SOFT = frozenset("menu menus share sharing social related recommend recommended recommendations search rail skip".split())
LISTS = frozenset("ul ol dl table".split())
EDGES = frozenset("header head banner masthead topbar footer foot bottombar".split())
PLAIN = frozenset("box boxes wrap wrapper container section area block list item items inner outer top bottom left right primary secondary bar side link links button buttons post posts site page global content module unit slot group row col panel holder region sticky fixed mobile desktop message text body title icons id class the".split())
ARTICLE = frozenset("post entry article content story".split())
#: End tags of these don't close an article, main, body or cell around them.
WEAK = frozenset("p li div b i span a ul".split())
#: Elements whose lines may go on where an article ends.
FLOW = frozenset("p blockquote pre li dd dt figcaption".split())
SIGMA = 1.5


class Line(NamedTuple):
    """holder: index of the innermost element around it that may hold an article. shut: it stands in what is none. title: in an h1. soft: index of a part that may be the article's own, or -1. tag: of its innermost block. linked: how many of its characters stand in links."""

    text: str
    tags: int
    holder: int
    shut: bool
    title: bool
    soft: int
    tag: str
    linked: int


class Lines(HTMLParser):
    """Lines of a page. Each tag takes constant time, however deep it lies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.link = False
        self.open: list[tuple[str, bool, int, int]] = [("", False, 0, -1)]  # tag, shut, holder, soft
        self.softs: list[str] = []  # the tag of each soft part
        self.places: dict[str, list[int]] = {}  # of each tag: where it stands in open
        self.holders: list[tuple[int, str]] = [(-1, "")]  # of each holder: the one around it, and its tag

    def push(self, tag: str, shut: bool, holder: int, soft: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, shut, holder, soft))

    def cut(self, to: int) -> None:
        while len(self.open) > to:
            self.places[self.open.pop()[0]].pop()

    def last(self, *tags: str) -> int:
        """Where the innermost open element of these tags stands; 0 for none."""
        return max(self.places[t][-1] if self.places.get(t) else 0 for t in tags)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tag, shut, holder, soft = self.open[-1]
            self.lines.append(Line(text, self.tags, holder, shut, self.last("h1") > 0, soft, tag, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        self.link = self.link or tag == "a"
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.open[-1][0] in ("p", *HEADINGS) or tag == self.open[-1][0] and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                self.cut(len(self.open) - 1)
        if tag in VOID:
            return
        marked, soft_name = self.marked(tag, attrs)
        if not (block or tag in SILENT):
            if not (marked or soft_name):
                return
            self.flush()
        _, shut, holder, soft = self.open[-1]
        shut = shut or tag in SILENT or tag in OUTSIDE or (tag == "header" and not self.last("article")) or marked
        if soft_name and soft < 0:
            self.softs.append(tag)
            soft = len(self.softs) - 1
        if tag in HOLDERS:
            self.holders.append((holder, tag))
            holder = len(self.holders) - 1
        self.push(tag, shut, holder, soft)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in SILENT:
            self.flush()
        self.link = self.link and tag != "a" and tag not in BLOCKS
        at = self.last(tag)
        if not at or tag in WEAK and self.last("article", "main", "body", "td") > at:
            return
        if tag not in BLOCKS and tag not in SILENT:
            self.flush()
        self.cut(at)

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] not in SILENT:
            self.parts.append(data)
            if self.link:
                self.linked += len("".join(data.split()))

    def marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether an element is a part that is not the article, and whether it may be one."""
        if tag in ("html", "body", "article", "main"):
            return tag == "article" and any(k == "class" and v and "comment" in v.lower() for k, v in attrs), False
        soft = False
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v and v.lower() in ROLES:
                return True, False
            if k in ("class", "id") and v and tag in CONTAINERS:
                for name in v.lower().split():
                    if name in SOFT and self.last("article", "main"):
                        soft = True
                    elif self.part(name):
                        return True, False
        return False, soft

    def part(self, name: str) -> bool:
        """Whether a class or id names a part that is not the article: each of its words is one for such parts, or says nothing, and one at least is for such parts."""
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in PARTS for w in words):
            return all(w in PARTS or w in EDGES or w in PLAIN for w in words)
        return any(w in EDGES for w in words) and all(w in EDGES or w in PLAIN for w in words) and not any(w in ARTICLE for w in words) and not self.last("article", "main")


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """x convolved with a Gaussian; the ends count only the lines that there are."""
    r = max(1, math.ceil(3 * sigma))
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, g)[r:-r] / np.convolve(np.ones(len(x)), g)[r:-r]


def running(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are running text: those in a cluster by the smoothed ratio of characters to tags, but for lines at its ends that only their neighbours lift. And which are by their own ratio."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    soft = smoothed(ratio)
    least = min(float(np.std(soft)), float(np.mean(soft)))  # of equal ratios all are running text
    on, own = soft >= least, ratio >= least
    edge = np.concatenate([[0], np.cumsum(on[1:] != on[:-1])])  # of lines: which cluster or gap they belong to
    place = np.arange(len(on))
    first, last = np.full(edge[-1] + 1, len(on)), np.full(edge[-1] + 1, -1)
    np.minimum.at(first, edge[own], place[own])
    np.maximum.at(last, edge[own], place[own])
    return on & (place >= first[edge]) & (place <= last[edge]), own


def own_parts(p: Lines, on: np.ndarray) -> set[int]:
    """Which soft parts are the article's own: lists and what holds running text, unless half of the characters stand in links."""
    size, linked, runs = ([0] * len(p.softs) for _ in range(3))
    for line, flows in zip(p.lines, on.tolist(), strict=True):
        if line.soft >= 0 and not line.shut:
            size[line.soft] += len("".join(line.text.split()))
            linked[line.soft] += line.linked
            runs[line.soft] += flows
    return {k for k, tag in enumerate(p.softs) if (runs[k] or tag in LISTS) and 2 * linked[k] < size[k]}


def widened(p: Lines, kept: list[int], inside: np.ndarray, beside: set[int]) -> list[int]:
    """kept, with the headline and what stands between, and with the lines around that go on in paragraphs and items of the elements `beside`."""
    lines = p.lines
    linked = lambda k: 2 * lines[k].linked >= len("".join(lines[k].text.split()))
    titles = [k for k in range(kept[0]) if lines[k].title and inside[k]]
    if any(lines[k].title for k in kept):
        before = []
    elif titles:
        before = [k for k in range(titles[-1], kept[0]) if inside[k] and (not linked(k) or k == titles[-1])]
    else:
        k = kept[0]
        while k and inside[k - 1] and not linked(k - 1) and lines[k - 1].holder in beside and lines[k - 1].tag in FLOW | HEADINGS:
            k -= 1
        before = list(range(k, kept[0]))
    k = kept[-1]
    while k + 1 < len(lines) and inside[k + 1] and not linked(k + 1) and lines[k + 1].holder in beside and lines[k + 1].tag in FLOW:
        k += 1
    return [*before, *kept, *range(kept[-1] + 1, k + 1)]


def blocks_of(html: str) -> list[str]:
    """The article's blocks in page order."""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    lines = p.lines
    if not lines:
        return []
    flows, alone = running(lines)
    own = own_parts(p, alone)
    inside = np.array([not x.shut and (x.soft < 0 or x.soft in own) for x in lines], bool)
    if not inside.any():
        return []
    on = flows & inside
    on = on if on.any() else inside
    count = [0] * len(p.holders)  # lines of clusters in each holder; a holder comes after the one around it
    for k in np.flatnonzero(on):
        count[lines[k].holder] += 1
    for h in range(len(count) - 1, 0, -1):
        count[p.holders[h][0]] += count[h]
    best = inner = max(h for h, n in enumerate(count) if n == count[0])
    while best > 0 and p.holders[best][1] not in ("article", "main"):
        best = p.holders[best][0]
    beside = set() if best > 0 else {p.holders[inner][0]}
    best = best if best > 0 else inner
    under = [h == best for h in range(len(count))]
    for h in range(best + 1, len(count)):
        under[h] = under[p.holders[h][0]]
    kept = [k for k in np.flatnonzero(inside).tolist() if under[lines[k].holder]]
    if p.holders[best][1] in ("", "body"):
        first, last = np.flatnonzero(on)[[0, -1]]
        kept = [k for k in kept if first <= k <= last]
        beside |= {lines[first].holder, lines[last].holder}
    return [lines[k].text for k in widened(p, kept, inside, beside)]


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks_of(html)) if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch["html"].to_pylist()]
        n = pa.array([len(x) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of each row. Nothing is shuffled."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
