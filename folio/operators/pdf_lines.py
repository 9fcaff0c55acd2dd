"""The structure of paged documents from tables of spans, lines, boxes and images; reading the files themselves is the source's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import html_escape

#: Class names of headings and folded groups.
TITLE_CLASS, GROUP_CLASS = "AmmAnnexeTitre", "ema-annexe"
#: Markers that wait for a title, and dividers that open a group.
MARKER_TOP, MARKER_SUB, MARKER_LETTER = r"^\d{1,2}\.$", r"^\d{1,2}\.\d{1,2}$", r"^[A-E]\.$"
DIVIDER = r"(?i)^ANNEXE\s+[IVX]+|^(RÉSUMÉ DES CARACTÉRISTIQUES|ÉTIQUETAGE ET NOTICE|ÉTIQUETAGE|NOTICE)\b"
GROUP_LABEL = r"(?i)ANNEXE\s+[IVX]+|RÉSUMÉ DES CARACTÉRISTIQUES|ÉTIQUETAGE|NOTICE"
OPEN_GROUP = r"(?i)RÉSUMÉ DES CARACTÉRISTIQUES"


def lines_of(spans: DataFrame) -> DataFrame:
    """(doc, page, y, line, text, bold) of (doc, page, y, line, ord, text, bold): bold if all spans that aren't blank are."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "")
    bold = F.coalesce(F.bool_and(F.when(F.trim("text") != "", F.col("bold"))), F.lit(True))
    return spans.groupBy("doc", "page", "y", "line").agg(F.trim(text).alias("text"), bold.alias("bold"))


def outside_tables(blocks: DataFrame, tables: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Blocks (doc, page, x0, y0, x1, y1, ...) that lie in no table of their page."""
    b, t = blocks.alias("b"), tables.alias("t")
    within = (F.col("b.x0") >= F.col("t.x0") - tolerance) & (F.col("b.y0") >= F.col("t.y0") - tolerance) & (F.col("b.x1") <= F.col("t.x1") + tolerance) & (F.col("b.y1") <= F.col("t.y1") + tolerance)
    return b.join(t, (F.col("b.doc") == F.col("t.doc")) & (F.col("b.page") == F.col("t.page")) & within, "left_anti")


def figures(images: DataFrame, least_side: int = 200) -> DataFrame:
    """Each image (doc, xref, page, y, width, height) once a document, where it comes first, unless both sides are small."""
    first = F.row_number().over(W.partitionBy("doc", "xref").orderBy("page", "y"))
    return images.filter((F.col("width") >= least_side) | (F.col("height") >= least_side)).withColumn("n", first).filter("n = 1").drop("n")


def structure(lines: DataFrame) -> DataFrame:
    """(doc, ord, kind, grp, sid, label) of (doc, page, y, line, text, bold): groups, headings (1 or 2) and text.

    A bold marker waits for the next line, its title. A divider, or a titled marker that names one, opens a group;
    dividers with nothing between them are one group. Text before the first is in group 0. Sections count from 1.
    """
    w = W.partitionBy("doc").orderBy("page", "y", "line")
    kept = lines.filter((F.col("text") != "") & ~((F.col("text") == F.col("page").cast("string")) & (F.col("y") < 90)))
    marker = F.col("bold") & F.col("text").rlike(f"{MARKER_TOP}|{MARKER_SUB}|{MARKER_LETTER}")
    rows = kept.withColumn("marker", marker).withColumn("before", F.when(F.lag("marker").over(w), F.lag("text").over(w)))
    label = F.when(F.col("before").isNotNull(), F.concat_ws(" ", "before", "text")).otherwise(F.col("text"))
    sub = F.coalesce(F.col("before").rlike(MARKER_SUB), F.lit(False))
    titled = F.col("before").isNotNull()
    kind = (
        F.when(titled & ~sub & label.rlike(GROUP_LABEL), "group").when(titled & sub, "heading2").when(titled, "heading1")
        .when(F.col("bold") & F.col("text").rlike(DIVIDER), "group").otherwise("text")
    )
    rows = rows.filter("NOT marker").select("doc", "page", "y", "line", kind.alias("kind"), label.alias("label"))
    opens = (F.col("kind") == "group") & ~F.coalesce(F.lag("kind").over(w) == "group", F.lit(False))
    rows = rows.withColumn("opens", opens)
    return rows.select(
        "doc", F.row_number().over(w).alias("ord"), "kind", F.sum(F.col("opens").cast("int")).over(w).alias("grp"),
        F.when(F.col("kind") == "heading1", F.concat(F.lit("sec-"), F.sum((F.col("kind") == "heading1").cast("int")).over(w))).alias("sid"), "label",
    )


def groups(rows: DataFrame) -> DataFrame:
    """(doc, grp, sid, title, open, n_parts): groups with anything in them; merged dividers are one title."""
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "group", F.struct("ord", "label")))), lambda s: s["label"]), " - ")
    got = rows.groupBy("doc", "grp").agg(titles.alias("title"), F.count_if(F.col("kind") != "group").alias("n_parts")).filter("n_parts > 0")
    n = F.row_number().over(W.partitionBy("doc").orderBy("grp"))
    return got.select("doc", "grp", F.concat(F.lit("grp-"), n).alias("sid"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Document")).alias("title"), F.col("title").rlike(OPEN_GROUP).alias("open"), "n_parts")


def table_html(rows: Column) -> Column:
    """An array of rows of escaped cells as a table, the first row as its head."""
    cells = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), F.coalesce(c, F.lit("")), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, cells(r, "th")).otherwise(cells(r, "td"))), "")
    return F.concat(F.lit("<table>"), body, F.lit("</table>"))


def reading_order(lines: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(doc, ord, kind, grp, sid, label, html): what a document holds, in the order that it is read in.

    ``lines`` (doc, page, block, line, x0, y0, x1, y1, text, bold), the box being the block's and ``line`` its order within it,
    ``tables`` (doc, page, x0, y0, x1, y1, rows: arrays of escaped cells), ``images`` (doc, page, y, xref, width, height, src). The
    three are one sequence by page and upper edge, of equal edges tables, then figures, then blocks. A table stands in for the
    blocks within it. Kinds are group, heading1, heading2, text (a block's lines up to a heading, as one paragraph), table and figure.

    A bold marker waits for the next line, its title; a figure does not end the wait, a table does. A divider, or a titled
    marker that names one, opens a group, dividers with nothing in between one group together. What comes before the first is in group
    0. A lone page number at the top is dropped, and a blank line. Each document is one ordered pass.
    """
    none = lambda t: F.lit(None).cast(t)
    at = ["doc", "page", "y", "rank", "block", "line"]
    text = outside_tables(lines, tables).filter((F.trim("text") != "") & ~((F.trim("text") == F.col("page").cast("string")) & (F.col("y0") < 90)))
    rows = text.select("doc", "page", F.col("y0").cast("double").alias("y"), F.lit(2).alias("rank"), F.col("block").cast("long").alias("block"), F.col("line").cast("long").alias("line"), F.trim("text").alias("text"), "bold", none("string").alias("html"))
    rows = rows.unionByName(tables.select("doc", "page", F.col("y0").cast("double").alias("y"), F.lit(0).alias("rank"), F.xxhash64("x0", "y0", "x1", "y1").alias("block"), F.lit(0).cast("long").alias("line"), none("string").alias("text"), F.lit(False).alias("bold"), table_html(F.col("rows")).alias("html")))
    shown = F.concat(F.lit('<figure><img src="'), html_escape(F.col("src")), F.lit('" alt=""></figure>'))
    rows = rows.unionByName(figures(images).select("doc", "page", F.col("y").cast("double").alias("y"), F.lit(1).alias("rank"), F.col("xref").cast("long").alias("block"), F.lit(0).cast("long").alias("line"), none("string").alias("text"), F.lit(False).alias("bold"), shown.alias("html")))
    w = W.partitionBy("doc").orderBy(*at[1:])
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    marker = (F.col("rank") == 2) & F.col("bold") & F.col("text").rlike(f"{MARKER_TOP}|{MARKER_SUB}|{MARKER_LETTER}")
    # figures are passed over; whatever else stands before a line says whether a marker waits for it
    rows = rows.withColumn("marker", marker).withColumn("last", F.last(F.when(F.col("rank") != 1, F.struct("marker", "text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("before", F.when((F.col("rank") == 2) & F.col("last.marker") & ~F.col("marker"), F.col("last.text")))
    titled, sub = F.col("before").isNotNull(), F.coalesce(F.col("before").rlike(MARKER_SUB), F.lit(False))
    label = F.when(titled, F.concat_ws(" ", "before", "text")).otherwise(F.col("text"))
    kind = (
        F.when(F.col("rank") == 0, "table").when(F.col("rank") == 1, "figure").when(F.col("marker"), "marker").when(titled & ~sub & label.rlike(GROUP_LABEL), "group")
        .when(titled & sub, "heading2").when(titled, "heading1").when(F.col("bold") & F.col("text").rlike(DIVIDER), "group").otherwise("text")
    )
    rows = rows.select(*at, kind.alias("kind"), label.alias("label"), "html")
    # a paragraph goes on while text follows text of its block
    goes_on = (F.col("kind") == "text") & (F.lag("kind").over(w) == "text") & (F.lag("block").over(w) == F.col("block")) & (F.lag("page").over(w) == F.col("page"))
    parts = rows.withColumn("part", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(so_far)).filter("kind <> 'marker'")
    parts = parts.groupBy("doc", "part", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "label"))), lambda x: x["label"]), " ").alias("label"), F.first("html").alias("html"))
    w = W.partitionBy("doc").orderBy("part")
    opens = (F.col("kind") == "group") & ~F.coalesce(F.lag("kind").over(w) == "group", F.lit(False))
    parts = parts.withColumn("opens", opens.cast("int"))
    numbered = parts.select("doc", F.row_number().over(w).alias("ord"), "kind", F.sum("opens").over(w).alias("grp"), F.when(F.col("kind") == "heading1", F.concat(F.lit("sec-"), F.sum((F.col("kind") == "heading1").cast("int")).over(w))).alias("sid"), "label", "html")
    shape = lambda tag, level, sid: F.concat(F.lit(f'<{tag} class="{TITLE_CLASS}{level}"'), sid, F.lit(">"), html_escape(F.col("label")), F.lit(f"</{tag}>"))
    own = F.when(F.col("kind") == "heading1", shape("h2", 1, F.concat(F.lit(' id="'), F.col("sid"), F.lit('"')))).when(F.col("kind") == "heading2", shape("h3", 2, F.lit("")))
    return numbered.withColumn("label", F.when(F.col("kind").isin("table", "figure"), none("string")).otherwise(F.col("label"))).withColumn("html", F.coalesce("html", own, F.when(F.col("kind") == "text", F.concat(F.lit("<p>"), html_escape(F.col("label")), F.lit("</p>")))))


#: Kinds of the rows of :func:`reading_order`.
KINDS = ("group", "heading1", "heading2", "text", "table", "figure")


def counted(rows: DataFrame) -> DataFrame:
    """(doc, n_KIND..., html, toc) of :func:`reading_order`: how many rows of each kind a document has beside what :func:`assembled`
    makes of it, in one pass over ``rows``; html and toc are null for a document without parts."""
    part = F.col("kind") != "group"
    ordered = lambda kept, value: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("ord", *value)))), lambda x: x.dropFields("ord"))
    per_group = rows.groupBy("doc", "grp").agg(
        F.array_join(F.transform(ordered(~part, ["label"]), lambda x: x["label"]), " - ").alias("title"),
        F.array_join(F.transform(ordered(part, [F.coalesce("html", F.lit("")).alias("html")]), lambda x: x["html"]), "").alias("inner"),
        ordered(F.col("kind") == "heading1", ["sid", "label"]).alias("subs"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
    )
    n_parts = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.lit(0))
    whole = per_group.groupBy("doc").agg(
        *[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(n_parts > 0, F.struct("grp", F.coalesce(F.nullif("title", F.lit("")), F.lit("Document")).alias("title"), F.col("title").rlike(OPEN_GROUP).alias("open"), "inner", "subs")))).alias("g"),
    )
    sid = lambda i: F.concat(F.lit("grp-"), i + 1)
    fold = lambda x, i: F.concat(F.lit(f'<details class="{GROUP_CLASS}"'), F.when(x["open"], " open").otherwise(""), F.lit('><summary id="'), sid(i), F.lit('">'), html_escape(x["title"]), F.lit("</summary>"), x["inner"], F.lit("</details>"))
    no_subs = F.array().cast("array<struct<sid:string,label:string>>")
    entry = lambda x, i: F.struct(sid(i).alias("sid"), x["title"].alias("label"), F.when(x["open"], x["subs"]).otherwise(no_subs).alias("subs"))
    html = F.concat(F.lit('<div id="textDocument">'), F.array_join(F.transform("g", fold), ""), F.lit("</div>"))
    some = F.size("g") > 0
    return whole.select("doc", *[f"n_{k}" for k in KINDS], F.when(some, html).alias("html"), F.when(some, F.transform("g", entry)).alias("toc"))


def assembled(rows: DataFrame) -> DataFrame:
    """(doc, html, toc) of :func:`reading_order`: each group a folded part, that of the main text open; empty groups go.

    toc holds (sid, label, subs): the groups, with the first-level headings of the open one below it. A document without parts has none.
    """
    return counted(rows).filter("html IS NOT NULL").select("doc", "html", "toc")
