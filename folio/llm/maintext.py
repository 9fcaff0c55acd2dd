"""Operator 12: the main text of web pages from parser events, text-to-tag ratios and their clusters.

The standard library's parser streams its events. Block borders cut them into lines; a line has its text, the tags met in it and
the container it stands in. Lines in menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader
comments go by the elements around them. What is left is selected by ratio: characters to a tag, smoothed over
neighbouring lines by a Gaussian; lines at or above the standard deviation are the core, and the container that holds the
core gives the text, short paragraphs between long ones included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label link map mark meta meter nobr output picture progress q rb rp rt rtc ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never shown as the page's own.
SILENT = frozenset("script style head title template noscript iframe object embed applet svg canvas audio video select option optgroup textarea button datalist input label legend".split())
#: Elements around the article, not of it.
AROUND = frozenset("nav header footer aside form menu dialog search".split())
#: Words of class and id names, and roles, that say the same of any element.
AROUND_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs contentinfo complementary cookie cookies consent dialog footer form gdpr header login masthead menu menubar modal nav navbar navigation"
    " newsletter notice notification pager pagination popup promo promotion search share sharing sharebar signup skip social sponsor sponsored subscribe subscription toolbar topbar".split()
)
#: The same for elements in which even an article of its own isn't the page's.
ASIDE_WORDS = frozenset("comment comments commentlist disqus related recommended recommendations replies reply respond responses sidebar teaser teasers".split())
#: What follows these in a name is not what the element is.
WITHOUT = frozenset("with has no without show hide is".split())
#: An element that starts ends those open ones, up to the borders.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BORDERS = frozenset("ul ol dl table tbody thead tfoot tr td th div section article main body html".split())
#: What an end tag of another name does not close.
FIRM = frozenset("article main body html table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Lines on either side that a line's ratio is smoothed with, and the Gaussian's deviation.
RADIUS, DEVIATION = 2, 1.0
#: Elements nested deeper than this count as part of the one they stand in; their text stays.
DEPTH = 512
#: A container is entered while it alone holds this share of the core's characters.
HOLDS = 0.8

_name_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_open_tag = re.compile(r"<(?=[a-zA-Z/!?])[^>]*\Z")


def _named(value: str) -> set[str]:
    """The words that a class or id attribute names its element by: the first and the last of each name, up to a "with", "has" or "no"."""
    out = set()
    for name in value.split():
        words = [w.lower() for w in _name_part.findall(name)]
        words = words[: next((i for i, w in enumerate(words) if w in WITHOUT), len(words))]
        out.update(words[:1] + words[-1:])
    return out


class _Element:
    """An open element. Whether it is silent holds for all in it; ``wraps``: it holds an article or, as a form, a first-level heading."""

    __slots__ = ("tag", "up", "depth", "around", "aside", "head", "root", "silent", "wraps", "same")

    def __init__(self, tag: str, up: _Element | None, given: dict[str, str]):
        self.tag, self.up, self.depth, self.wraps, self.same = tag, up, up.depth + 1 if up else 0, False, 0
        role = given.get("role", "").lower()
        words = _named(given.get("class", "")) | _named(given.get("id", "")) | {role}
        free = tag in ("html", "body", "main")
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        self.root = tag in ("article", "main") or role in ("article", "main") or given.get("itemprop", "").lower() == "articlebody"
        self.silent = bool(up and up.silent) or tag in SILENT or hidden and not free
        self.aside = not free and (tag == "aside" or bool(words & ASIDE_WORDS))
        self.head = tag == "header" or "header" in words
        self.around = not free and not self.root and (tag in AROUND or bool(words & AROUND_WORDS))

    @property
    def plain(self) -> bool:
        return not (self.around or self.aside or self.root or self.silent and not self.up.silent)


class _Lines(HTMLParser):
    """The lines of a page: (text, characters in links, tags, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at, self.lines, self.text, self.links, self.tags, self.anchor = _Element("", None, {}), [], [], 0, 0, False

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.links, self.tags, self.at))
                self.links = self.tags = 0
            self.text = []

    def _close(self, tag: str, borders: frozenset) -> bool:
        """Close the innermost open element of that name, with all in it, unless a border stands in between."""
        e = self.at
        while e.up is not None and e.tag != tag:
            if e.tag in borders:
                return False
            e = e.up
        if e.up is None:
            return False
        self.at = e.up
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag not in INLINE
        if block:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.anchor = True
        given = {k: v or "" for k, v in attrs}
        if not block:  # such an element matters only where its name says something
            e = _Element(tag, self.at, given)
            if e.plain:
                self.at.same += tag == self.at.tag
            elif e.depth <= DEPTH:
                e.silent = e.silent or e.around or e.aside  # a line's own element is the block
                self.at = e
            return
        self._close("p", BORDERS)
        if tag == "body":
            self._close("head", frozenset())
        for other in ENDS.get(tag, ()):
            self._close(other, BORDERS - {"tr", "td", "th"} if tag == "tr" else BORDERS - {other})
        if tag in ("article", "main"):  # these don't stand in what surrounds them, if that was left open
            for other in ("nav", "header", "footer", "menu"):
                self._close(other, frozenset(("aside",)))
        e = _Element(tag, self.at, given)
        if e.depth > DEPTH:
            return
        self.at = e
        if e.root or tag == "h1":
            up = e.up
            while up is not None:
                up.wraps = up.wraps or e.root or up.tag == "form"
                up = up.up

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing but on void elements

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.anchor = False
        if tag in VOID:
            return
        if tag not in INLINE:
            self._close(tag, FIRM - {tag})
        elif self.at.tag == tag and self.at.same:
            self.at.same -= 1
        else:
            self._close(tag, BORDERS | {"p"})

    def handle_data(self, data: str) -> None:
        if not self.at.silent:
            self.text.append(data)
            if self.anchor:
                self.links += len(data.strip())


def _path(e: _Element) -> list[_Element]:
    """From the page down to the element."""
    out = []
    while e is not None:
        out.append(e)
        e = e.up
    return out[::-1]


def _outside(path: list[_Element]) -> bool:
    """Whether a line stands in what surrounds the article."""
    inner = False
    for i in range(len(path) - 1, -1, -1):
        e = path[i]
        if e.aside:
            return True
        if e.around and not inner and not (e.tag == "form" and e.wraps):
            # an article's own header keeps its headings
            if not (e.head and any(x.root for x in path[:i]) and any(x.tag in HEADINGS for x in path[i:])):
                return True
        inner = inner or e.root
    return False


def smoothed(ratio: np.ndarray, radius: int = RADIUS, deviation: float = DEVIATION) -> np.ndarray:
    """Each line's ratio averaged with its neighbours', by a Gaussian of their distance; at the ends only over the lines there are."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * deviation**2))
    wide = np.convolve(ratio, kernel)[radius : radius + len(ratio)]
    return wide / np.convolve(np.ones(len(ratio)), kernel)[radius : radius + len(ratio)]


def _region(lines: list[tuple], paths: list[list[_Element]]) -> list[bool]:
    """Which lines belong to the container of the core."""
    size = np.array([len(x[0]) for x in lines], float)
    smooth = smoothed(size / np.maximum(1, [x[2] for x in lines]))
    core = smooth >= smooth.std()
    named = [next((i for i in range(len(p) - 1, -1, -1) if p[i].root), -1) for p in paths]
    roots = {p[i] for p, i in zip(paths, named, strict=True) if i >= 0}
    if roots:
        # of several articles those that hold some of the core
        chosen = {p[i] for p, i, c in zip(paths, named, core, strict=True) if i >= 0 and c} if len(roots) > 1 else roots
        return [any(e in (chosen or roots) for e in p) for p in paths]
    inside, depth = core.copy(), 0
    while True:
        held: dict[_Element, float] = {}
        for p, c, n in zip(paths, inside, size, strict=True):
            if c and len(p) > depth + 1 and p[depth + 1].tag in BORDERS:
                held[p[depth + 1]] = held.get(p[depth + 1], 0) + n
        best = max(held, key=held.get, default=None)
        if best is None or best.tag not in BORDERS - {"ul", "ol", "dl", "tr", "tbody"} or held[best] < HOLDS * size[inside].sum():
            break
        inside, depth, at = inside & np.array([len(p) > depth + 1 and p[depth + 1] is best for p in paths]), depth + 1, best
    here = np.array([len(p) > depth and (not depth or p[depth] is at) for p in paths])
    # parts of it without core that are mostly links are menus
    parts: dict[object, list[int]] = {}
    for i, p in enumerate(paths):
        if here[i] and len(p) > depth + 1 and p[depth + 1].tag in BORDERS:
            parts.setdefault(p[depth + 1], []).append(i)
    for found in parts.values():
        if not core[found].any() and sum(lines[i][1] for i in found) > 0.5 * size[found].sum():
            here[found] = False
    return here.tolist()


def main_text(html: str | None) -> str:
    """The main text of one page; "" of a null, an empty one, and one without any."""
    parser = _Lines()
    parser.feed(_open_tag.sub("", html or ""))  # a tag that the page's end cuts is markup
    parser.close()
    parser.end_line()
    lines = [(x, p) for x in parser.lines if not _outside(p := _path(x[3]))]
    if not lines:
        return ""
    paths = [p for _, p in lines]
    chosen = _region([x for x, _ in lines], paths)
    return " ".join(x[0] for (x, _), c in zip(lines, chosen, strict=True) if c)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html); repeated rows stay, further columns play no part.

    A null or empty page has the text "". Ids and addresses may be null. White space within a block is one space, blocks are
    joined by one; nothing is cut. Elements that a page leaves open end with the one around them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages)
