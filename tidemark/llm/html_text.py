"""Main text of web pages from parser events and text density.

The standard library's parser streams start tags, end tags and text; what stands between two
block boundaries is a line, with its characters outside links over its tags as its density.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, by
element or by what their class, id or role says, give no lines.  The densities, in page order,
are smoothed by a Gaussian; two clusters of them are told apart by a threshold, and the dense
lines mark the content region: the articles or the main element that hold them, where these hold
the better part of the dense text, else the innermost container around nearly all of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
LEFT_OUT = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object svg canvas video audio dialog menu".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# Elements that hold a page's blocks; a region is one of them.
CONTAINERS = frozenset("html body main article section div center table tbody tr td blockquote".split())

HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|"
    r"notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|paywall|signup|login|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|toolbar|skip|"
    r"header|masthead|topbar|footer|footnav|colophon|copyright|sidebar|side|rail|widget|widgets|"
    r"share|sharing|social|related|recommended|recommendations|more-stories|trending|tags|tagcloud|"
    r"comment|comments|commentlist|respond|disqus|reply|replies|discussion|reviews|search|form)(?:$|[\s_-]|\d)"
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Words of layout, not of the element itself: "has-sidebar" is the content beside a sidebar.
LAYOUT = re.compile(r"^(?:has|with|no|without|not|is)[-_]")
TITLE = re.compile(r"header")

SIGMA = 1.0
RADIUS = 3
BOUNDS = frozenset("ul ol dl table article main section div body".split())  # an open item is not closed across these


def hinted(hints: dict[str, str], inside: bool) -> bool:
    """Whether class or id name a part that is not content; an article's own header is."""
    for word in f"{hints.get('class', '')} {hints.get('id', '')}".split():
        if HINT.search(word) and not LAYOUT.match(word) and not (inside and TITLE.search(word)):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of a page: text, density, the element they stand in, and whether all is links.

    Elements are numbered as they open and know the one around them (``up``); 0 is the page.
    For every tag the places of its open elements are kept, so no tag looks through the stack.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.up, self.left = [""], [0], [False]
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.bounds, self.blocks = [-1], [-1]
        self.lines: list[tuple[str, float, int, bool]] = []
        self.articles: list[int] = []
        self.mains: list[int] = []
        self.out = self.links = self.inside = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            plain = max(0, len(text) - self.linked)
            self.lines.append((text, plain / (1 + self.tags), self.open[-1] if self.open else 0, plain == 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def _push(self, tag: str, left: bool):
        place = len(self.open)
        self.tag.append(tag)
        self.up.append(self.open[-1] if self.open else 0)
        self.left.append(left)
        self.open.append(len(self.tag) - 1)
        self.places.setdefault(tag, []).append(place)
        if tag in BOUNDS:
            self.bounds.append(place)
        if tag not in INLINE:
            self.blocks.append(place)
        self.out += left
        self.links += tag == "a"
        self.inside += tag in ("article", "main")

    def _pop(self, at: int):
        while len(self.open) > at:
            element = self.open.pop()
            tag = self.tag[element]
            self.places[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.out -= self.left[element]
            self.links -= tag == "a"
            self.inside -= tag in ("article", "main")

    def _close(self, tags):
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if at > self.bounds[-1]:
            self._pop(at)

    def handle_starttag(self, tag, attrs):
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag not in VOID:
                self._close(("p",))
                if tag in CLOSES:
                    self._close(CLOSES[tag])
        else:
            self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        hints = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "hidden", "style", "aria-hidden", "itemprop")}
        inside = self.inside > 0
        left = (
            tag in LEFT_OUT
            or (tag == "header" and not inside)
            or hints.get("role") in ROLES
            or "hidden" in hints
            or hints.get("aria-hidden") == "true"
            or "display:none" in hints.get("style", "").replace(" ", "")
            or (tag not in ("html", "body", "main", "article") and hinted(hints, inside))
        )
        self._push(tag, left)
        if not self.out:
            if tag == "article":
                self.articles.append(self.open[-1])
            elif tag == "main" or hints.get("role") == "main" or hints.get("itemprop") == "articlebody":
                self.mains.append(self.open[-1])

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        else:
            self.tags += 1
        at = self.places.get(tag)
        if at and (tag not in INLINE or at[-1] > self.blocks[-1]):
            self._pop(at[-1])

    def handle_data(self, data):
        if not self.out:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside are made to add up to one."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    n = len(values)
    total = np.convolve(values, kernel)[radius : radius + n]
    return total / np.convolve(np.ones(n), kernel)[radius : radius + n]


def threshold(values: np.ndarray) -> float:
    """Middle between the means of two clusters; below all values when they are of one kind."""
    low, high = float(values.min()), float(values.max())
    if high - low < 0.5:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        a, b = values[values < cut], values[values >= cut]
        if not len(a) or not len(b):
            break
        if (a.mean(), b.mean()) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def _within(up: list[int], regions) -> list[bool]:
    """Per element whether it is one of ``regions`` or stands in one."""
    inside = [False] * len(up)
    for e in regions:
        inside[e] = True
    for e in range(1, len(up)):
        inside[e] = inside[e] or inside[up[e]]
    return inside


def main_text(html: str | None) -> str:
    """The article of a page as one line; empty if there is none."""
    page = _Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    lines, up = page.lines, page.up
    if not lines:
        return ""
    dense = smooth(np.array([math.log1p(d) for _, d, _, _ in lines]))
    chosen = dense >= threshold(dense)
    # Dense characters and lines of every element, its inner ones included: children come later.
    weight, several, spoken = [0] * len(up), [0] * len(up), [0] * len(up)
    for c, (text, _, element, menu) in zip(chosen, lines):
        weight[element] += len(text) if c else 0
        several[element] += 1
        spoken[element] += not menu
    for e in range(len(up) - 1, 0, -1):
        weight[up[e]] += weight[e]
        several[up[e]] += several[e]
        spoken[up[e]] += spoken[e]
    total = weight[0]
    for regions in (page.articles, page.mains):
        around = _within(up, regions)
        outer = [e for e in regions if not around[up[e]]]
        if outer and 2 * sum(weight[e] for e in outer) >= total:
            # Of several, those of nothing but links are teasers.
            inside = _within(up, [e for e in outer if spoken[e]] or outer)
            return " ".join(t for t, _, e, _ in lines if inside[e])
    # The innermost container of several lines with nearly all dense text, and all its lines; only
    # those of nothing but links before its first and behind its last dense line are a menu.
    inner = max((e for e in range(1, len(up)) if page.tag[e] in CONTAINERS and weight[e] >= 0.8 * total and several[e] > 1), default=0)
    inside = _within(up, [inner])
    held = [i for i, line in enumerate(lines) if inside[line[2]]]
    marked = [i for i in held if chosen[i]]
    return " ".join(lines[i][0] for i in held if marked[0] <= i <= marked[-1] or not lines[i][3])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def html_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (main text), ``n_chars`` (its code points).

    Character references are decoded; white space inside a block becomes one space, blocks are
    joined in page order by one space.  Null or empty html, and pages without content, have the
    empty text.  Markup that is broken off or not closed is read as far as it goes.  Null ids
    and urls stay null; repeated rows stay; an empty table gives an empty result; other columns
    are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
