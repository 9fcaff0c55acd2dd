"""Articles within pages: the body of a crawled page, its denomination, and links put into its text.

The tree is the standard library's stream of tags, one document at a time; which terms a document may link is a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.batches import map_documents
from folio.functions.text import html_escape, repair_cp1252

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Names that pages and articles use.
PANEL, COLUMN, TITLE, NAME, ANCHOR = "tabpanel-rcp-panel", "contenu", "AmmAnnexeTitre", "AmmDenomination", "RcpDenomination"
JUNK = frozenset("script style button nav form".split())
ENVELOPE = ('<!DOCTYPE html>\n<html>\n<body><div id="textDocument">', "</div></body>\n</html>")


class _Events(HTMLParser):
    """(kind, tag, attributes, source) of a document in order; kinds are open, close and text. Closing tags that nothing opened go,
    and missing ones are put in, so that elements nest."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[tuple[str, str, dict, str]] = []
        self.stack: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.out.append(("open", tag, {k: v or "" for k, v in attrs}, self.get_starttag_text() or ""))
        if tag in _VOID:
            self.out.append(("close", tag, {}, ""))
        else:
            self.stack.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while (last := self.stack.pop()) != tag:
                self.out.append(("close", last, {}, f"</{last}>"))
            self.out.append(("close", tag, {}, f"</{tag}>"))

    def handle_data(self, data: str) -> None:
        self.out.append(("text", "", {}, data))

    def handle_entityref(self, name: str) -> None:
        self.out.append(("text", "", {}, f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.out.append(("text", "", {}, f"&#{name};"))


def events(html: str | None) -> list[tuple[str, str, dict, str]]:
    p = _Events()
    p.feed(html or "")
    p.close()
    while p.stack:
        p.handle_endtag(p.stack[-1])
    return p.out


def _element(ev: list, start: int) -> int:
    """The place behind the element that opens at ``start``."""
    depth = 0
    for i in range(start, len(ev)):
        depth += (ev[i][0] == "open") - (ev[i][0] == "close")
        if not depth:
            return i + 1
    return len(ev)


def _first(ev: list, test, lo: int = 0, hi: int | None = None) -> int:
    return next((i for i in range(lo, len(ev) if hi is None else hi) if ev[i][0] == "open" and test(ev[i][1], ev[i][2])), -1)


def _has_class(part: str):
    return lambda tag, a: part in a.get("class", "")


def article(html: str | None) -> str:
    """The article of a page in its envelope; empty if the page has no panel, no content column or no title of the first level."""
    ev = events(html)
    at = _first(ev, lambda tag, a: a.get("id") == PANEL)
    if at < 0:
        return ""
    end, title = _element(ev, at), _has_class(TITLE + "1")
    column = _first(ev, lambda tag, a: tag == "div" and a.get("id") == COLUMN, at + 1, end)
    if column < 0:
        column = next((i for i in range(at + 1, end) if ev[i][0] == "open" and ev[i][1] == "div" and "fr-col" in ev[i][2].get("class", "") and _first(ev, title, i + 1, _element(ev, i)) >= 0), -1)
    if column < 0 or _first(ev, title, column + 1, stop := _element(ev, column)) < 0:
        return ""
    out, i = [], column + 1
    while i < stop - 1:
        kind, tag, a, source = ev[i]
        if kind == "open" and (tag in JUNK or "fr-no-print" in a.get("class", "").split()):
            i = _element(ev, i)
            continue
        out.append(source)
        i += 1
    return ENVELOPE[0] + "".join(out) + ENVELOPE[1]


def _plain(ev: list, lo: int, hi: int) -> str:
    from html import unescape

    return unescape("".join(e[3] for e in ev[lo:hi] if e[0] == "text")).strip()


def denomination(html: str | None) -> str:
    """The name that an article gives: its own element, else the first text after the title of the named anchor."""
    ev = events(html)
    at = _first(ev, _has_class(NAME))
    if at >= 0 and (name := _plain(ev, at, _element(ev, at))):
        return name
    anchor = _first(ev, lambda tag, a: tag == "a" and a.get("name") == ANCHOR)
    if anchor < 0:
        return ""
    depth, parent = 0, anchor  # the element around the anchor
    while parent >= 0 and not (depth == 0 and parent < anchor and ev[parent][0] == "open"):
        parent -= 1
        depth += (ev[parent][0] == "close") - (ev[parent][0] == "open" and depth > 0) if parent >= 0 else 0
    i = _element(ev, parent) if parent >= 0 else len(ev)
    while i < len(ev) and ev[i][0] != "close":
        if ev[i][0] == "open":
            if TITLE + "1" in ev[i][2].get("class", ""):
                return ""
            end = _element(ev, i)
            if name := _plain(ev, i, end):
                return name
            i = end
        else:
            i += 1
    return ""


class _WordPlaces(HTMLParser):
    """Where each folded word first stands in the text that may hold links: not within links, titles, the denomination, scripts or styles."""

    def __init__(self, html: str, fold: dict[int, str]) -> None:
        super().__init__(convert_charrefs=False)
        self.first: dict[str, int] = {}
        self.open: list[tuple[str, bool]] = []
        self.fold, self.lines = fold, [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _VOID:
            css = next((v or "" for k, v in attrs if k == "class"), "")
            closed = tag in ("a", "script", "style") or TITLE in css or NAME in css
            self.open.append((tag, closed or bool(self.open and self.open[-1][1])))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), -1)
        if at >= 0:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            line, column = self.getpos()
            for m in re.finditer(r"[A-Z0-9]+", data.translate(self.fold)):
                self.first.setdefault(m[0], self.lines[line - 1] + column + m.start())


def articles(pages: DataFrame) -> DataFrame:
    """(key, html, name) of crawled pages (key, html): the article in its envelope, empty without one, and the name it gives."""

    def cut(html: str | None) -> Iterator[tuple]:
        yield (out := article(html)), denomination(out)

    kind = pages.schema["key"].dataType.simpleString()
    return map_documents(pages.select("key", repair_cp1252(F.col("html")).alias("html")), cut, f"key {kind}, html string, name string")


#: Link terms that are broadcast at most; more of them meet the words by shuffle.
BROADCAST_TERMS = 200_000


def linked(docs: DataFrame, terms: DataFrame, budget: int = 15) -> DataFrame:
    """(key, html, slugs) of documents (key, html) with links to ``terms`` (term, key, slug) put into them, none to themselves.

    The first place of each term is linked, at most ``budget`` of them in the order of the text (the feature's own limit); slugs are
    the distinct ones linked, in that order. What is not linked stays as it is. A worker gives a document's words with their places
    alone; terms meet them by a join, and the links are put in by column functions. Keys must be unique; a null page is an empty one.
    """
    from folio.functions.text import ACCENT_GROUPS

    fold = {i: chr(i - 32) for i in range(97, 123)} | {ord(c): b for g, b in ACCENT_GROUPS for c in g + g.upper()}
    kind = docs.schema["key"].dataType.simpleString()

    def places(html: str | None) -> Iterator[tuple]:
        return iter(_WordPlaces(html or "", fold).first.items())

    near = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda df: df)
    words = map_documents(docs.select("key", "html"), places, f"key {kind}, term string, at int")
    hits = words.join(near(terms.select("term", F.col("key").alias("target"), "slug")), "term").filter("NOT (key <=> target)")
    placed = hits.groupBy("key", "at", "term").agg(F.min("slug").alias("slug")).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("at"))).filter(F.col("n") <= budget)
    marks = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.length("term").alias("n"), "slug"))).alias("m"))  # budget at most
    html, m = F.coalesce("html", F.lit("")), F.coalesce("m", F.array().cast("array<struct<at:int,n:int,slug:string>>"))
    end = lambda i: F.coalesce(F.get(m, i)["at"] + F.get(m, i)["n"], F.lit(0))
    link = lambda x: F.concat(F.lit('<a class="drug-xref" href="/rcp/'), html_escape(x["slug"]), F.lit('">'), F.substring(html, x["at"] + 1, x["n"]), F.lit("</a>"))
    parts = F.transform(m, lambda x, i: F.concat(F.substring(html, end(i - 1) + 1, x["at"] - end(i - 1)), link(x)))
    tail = F.substring(html, end(F.size(m) - 1) + 1, F.length(html))
    return docs.select("key", "html").join(marks, "key", "left").select("key", F.concat(F.array_join(parts, ""), tail).alias("html"), F.array_distinct(F.transform(m, lambda x: x["slug"])).alias("slugs"))


def cleaned(docs: DataFrame, terms: DataFrame, budget: int = 15) -> DataFrame:
    """(key, name, html, toc, slugs) of articles (key, html): the whole way from an article to what a page shows. Keys must be unique."""
    from folio.operators.html_blocks import blocks, table_of_contents

    toc = table_of_contents(blocks(docs))
    by_page = toc.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "level", "title", "parent"))), lambda x: x.dropFields("ord")).alias("toc"))

    def names(html: str | None) -> Iterator[tuple]:
        yield (denomination(html),)

    kind = docs.schema["key"].dataType.simpleString()
    named = map_documents(docs.select("key", "html"), names, f"key {kind}, name string")
    return linked(docs, terms, budget).join(named, "key").join(by_page, "key", "left").select("key", "name", "html", F.coalesce("toc", F.array()).alias("toc"), "slugs")
