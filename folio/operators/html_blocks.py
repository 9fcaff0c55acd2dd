"""HTML documents to rows: blocks, headings and retrieval chunks. The parser is the standard library's, one document at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import chunking as C
from folio.functions.batches import map_documents, text_pieces
from folio.functions.text import heading_path, is_filler, repair_cp1252

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style button nav form".split())
_BLOCK = frozenset("p li dd dt caption div section article h1 h2 h3 h4 h5 h6 tr blockquote".split())
_TITLE = re.compile(r"AmmAnnexeTitre(\d)")
_DROP_CLASS = re.compile(r"\b(no-print|infobulle|tooltip|back-to-top|haut-page)\b")


class _Blocks(HTMLParser):
    """Flat blocks of a document: (kind, level, id, text); kinds are heading, text and row (a table's line).

    There is no tree repair: a block ends where another block element begins or ends; what script, style, navigation and
    decoration hold is left out; a table that is no data table counts as text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str, str] | list[list[str]]] = []  # a data table stands as its rows
        self.text: list[str] = []
        self.level, self.id = 0, ""
        self.hidden: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def flush(self) -> None:
        t = " ".join("".join(self.text).split())
        self.text = []
        if self.level:
            self.blocks.append(("heading", self.level, self.id, t))
            self.level, self.id = 0, ""
        elif t:
            self.blocks.append(("text", 0, "", t))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if self.hidden:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        css = a.get("class", "")
        if tag in _SKIP or _DROP_CLASS.search(css):
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if tag == "table":
            self.flush()
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
        elif tag == "br":
            (self.text if self.cell is None else self.cell).append(" ")
        elif not self.tables and tag in _BLOCK:
            self.flush()
            title = _TITLE.search(css)
            if title or re.fullmatch(r"h[1-6]", tag):
                self.level = int(title[1]) if title else int(tag[1])
                self.id = a.get("id", "")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden and self.hidden.pop() != tag:
                    pass
            return
        if self.tables and tag in ("td", "th") and self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif self.tables and tag == "table":
            rows = self.tables.pop()
            if C.is_data_table(rows):
                self.blocks.append(rows)
            elif flat := " ".join(v for r in rows for v in r if v):
                self.blocks.append(("text", 0, "", flat))
        elif not self.tables and tag in _BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.cell is None else self.cell).append(data)

    def done(self) -> Iterator[tuple[str, int, str, str]]:
        self.close()
        while self.tables:
            self.handle_endtag("table")
        self.flush()
        for b in self.blocks:
            if isinstance(b, list):
                yield from (("row", 0, "", line) for line in C.row_lines(b))
            else:
                yield b


def parse_blocks(html: str | None) -> Iterator[tuple[str, int, str, str]]:
    p = _Blocks()
    p.feed(html or "")
    return p.done()


def blocks(docs: DataFrame) -> DataFrame:
    """(key, ord, kind, level, id, text) of (key, html), after repair of Windows-1252 controls; no order across documents."""

    def parse(html: str | None) -> Iterator[tuple]:
        return ((n, *x) for n, x in enumerate(parse_blocks(html)))

    kind = docs.schema["key"].dataType.simpleString()
    return map_documents(docs.select("key", repair_cp1252(F.col("html")).alias("html")), parse, f"key {kind}, ord int, kind string, level int, id string, text string", longer=-1)


def table_of_contents(rows: DataFrame, depth: int = 2) -> DataFrame:
    """(key, ord, id, level, title, parent): level-1 headings are sec-N, deeper ones sub-N; own ids stay.

    Headings without text take no number; the parent is the nearest earlier heading of a lower level within ``depth``.
    """
    h = rows.filter("kind = 'heading' AND text <> ''").filter(F.col("level") <= depth)
    w = W.partitionBy("key").orderBy("ord")
    top = F.col("level") == 1
    h = h.withColumn("n_top", F.sum(top.cast("int")).over(w)).withColumn("n_sub", F.sum((~top).cast("int")).over(w))
    h = h.withColumn("sid", F.coalesce(F.nullif("id", F.lit("")), F.when(top, F.concat(F.lit("sec-"), F.col("n_top") - 1)).otherwise(F.concat(F.lit("sub-"), F.col("n_sub") - 1))))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    parent = F.lit(None).cast("string")
    for level in range(depth - 1, 0, -1):  # the nearest of any lower level
        last = F.last(F.when(F.col("level") == level, F.struct("ord", "sid")), True).over(before)
        parent = F.when((F.col("level") > level) & last.isNotNull(), last["sid"]).otherwise(parent) if level == depth - 1 else F.coalesce(parent, F.when(F.col("level") > level, last["sid"]))
    return h.select("key", "ord", F.col("sid").alias("id"), "level", F.col("text").alias("title"), parent.alias("parent"))


def sections(rows: DataFrame, levels: int = 9) -> DataFrame:
    """Block rows (key, ord, kind, level, id, text) that are no headings, with run, sec and title.

    Each heading opens a run. ``sec`` is the section of the last heading of level 1: its own id, or sec-N over titles with
    text where no such heading of the page has one; empty before the first and below an empty title. ``title`` is the
    path of headings in force, a heading ending all deeper ones.
    """
    w = W.partitionBy("key").orderBy("ord")
    heading, top = F.col("kind") == "heading", (F.col("kind") == "heading") & (F.col("level") == 1)
    rows = rows.withColumn("run", F.sum(heading.cast("int")).over(w)).withColumn("n_top", F.sum((top & (F.col("text") != "")).cast("int")).over(w))
    rows = rows.withColumn("own_ids", F.max((top & (F.col("id") != "")).cast("int")).over(W.partitionBy("key")))
    numbered = F.when(F.col("text") != "", F.concat(F.lit("sec-"), (F.col("n_top") - 1).cast("string"))).otherwise("")
    rows = rows.withColumn("sec", F.coalesce(F.last(F.when(top, F.when(F.col("own_ids") == 1, F.col("id")).otherwise(numbered)), True).over(w), F.lit("")))
    path = []
    for k in range(1, levels + 1):
        own = F.last(F.when(heading & (F.col("level") == k), F.struct("ord", "text")), True).over(w)
        above = F.max(F.when(heading & (F.col("level") < k), F.col("ord"))).over(w)
        path.append(F.when(own["ord"] > F.coalesce(above, F.lit(-1)), own["text"]))
    return rows.withColumn("title", heading_path(*path)).filter(~heading).select("key", "ord", "kind", "text", "run", "sec", "title")


def merged(pieces: Column, below: int = C.MERGE_BELOW, ceiling: int = C.CEILING) -> Column:
    """An array of pieces in which a short one, or one behind a short one, is part of the one before as long as the sum fits."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(a: Column, c: Column) -> Column:
        fits = (F.least(F.length(a["open"]), F.length(c)) < below) & (F.length(a["open"]) + 1 + F.length(c) <= ceiling)
        joins = F.coalesce(fits, F.lit(False))
        return F.struct(F.when(joins | a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(joins, F.concat_ws(" ", a["open"], c)).otherwise(c).alias("open"))

    return F.aggregate(pieces, start, add, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _sentences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in text_pieces(batches):
        yield pa.array([C.sentence_chunks(t or "") for t in texts], pa.list_(pa.string()))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """(key, ord, sec, snippet, chunk) of block rows: whole sentences of a run, then its table lines; a body counts once a page.

    Paragraphs without content and blocks outside a section are left out. A chunk is its title's path and its body.
    """
    kept = sections(rows).filter((F.col("sec") != "") & ((F.col("kind") == "row") | ~is_filler(F.col("text"))))
    part = F.when(F.col("kind") == "row", F.col("ord") + 1).otherwise(0)
    prose = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    parts = kept.withColumn("part", part).groupBy("key", "run", "sec", "title", "part").agg(prose.alias("text")).withColumn("pieces", _sentences("text"))
    bodies = parts.select("key", "run", "sec", "title", "part", F.posexplode(F.when(F.col("part") == 0, merged(F.col("pieces"))).otherwise(F.col("pieces"))).alias("pos", "body")).filter(F.length("body") >= C.LEAST)
    first = bodies.groupBy("key", "body").agg(F.min(F.struct("run", "part", "pos", "sec", "title")).alias("x")).select("key", "body", "x.*")
    place = F.row_number().over(W.partitionBy("key").orderBy("run", "part", "pos"))
    return first.withColumn("ord", place - 1).select("key", "ord", "sec", F.left("body", F.lit(C.SNIPPET)).alias("snippet"), F.concat("title", F.lit("\n"), "body").alias("chunk"))


def chunks(docs: DataFrame) -> DataFrame:
    """(key, ord, sec, snippet, chunk) of (key, html)."""
    return chunk_rows(blocks(docs))
