"""Paged documents and page pieces on small fixtures."""

import json

from pyspark.sql import functions as F

from folio.operators import pages, pdf_lines


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_structure_of_lines(spark):
    lines = [
        (1, 10, "1", False), (1, 100, "ANNEXE I", True), (1, 110, "RÉSUMÉ DES CARACTÉRISTIQUES DU PRODUIT", True), (1, 120, "1.", True), (1, 130, "DÉNOMINATION", True), (1, 140, "Texte.", False),
        (2, 100, "4.1", True), (2, 110, "Indications", True), (2, 120, "B.", True), (2, 130, "NOTICE", True), (2, 140, "Fin 1", False), (2, 150, "A.", True), (2, 160, "FABRICANT", True),
    ]
    df = spark.createDataFrame([("d", p, float(y), 0, t, b) for p, y, t, b in lines], "doc string, page int, y double, line int, text string, bold boolean")
    s = pdf_lines.structure(df)
    got = [(r["kind"], r["grp"], r["sid"], r["label"]) for r in s.orderBy("ord").collect()]
    assert got == [
        ("group", 1, None, "ANNEXE I"), ("group", 1, None, "RÉSUMÉ DES CARACTÉRISTIQUES DU PRODUIT"), ("heading1", 1, "sec-1", "1. DÉNOMINATION"), ("text", 1, None, "Texte."),
        ("heading2", 1, None, "4.1 Indications"), ("group", 2, None, "B. NOTICE"), ("text", 2, None, "Fin 1"), ("heading1", 2, "sec-2", "A. FABRICANT"),
    ]
    assert rows(pdf_lines.groups(s).select("sid", "title", "open")) == [("grp-1", "ANNEXE I - RÉSUMÉ DES CARACTÉRISTIQUES DU PRODUIT", True), ("grp-2", "B. NOTICE", False)]


def test_spans_boxes_and_figures(spark):
    spans = spark.createDataFrame([("d", 1, 1.0, 0, 0, "A", True), ("d", 1, 1.0, 0, 1, " ", False), ("d", 1, 2.0, 0, 0, "b", False), ("d", 1, 2.0, 0, 1, "C", True)], "doc string, page int, y double, line int, ord int, text string, bold boolean")
    assert rows(pdf_lines.lines_of(spans).select("text", "bold")) == [("A", True), ("bC", False)]
    box = "doc string, page int, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([("d", 1, 9.0, 9.0, 20.0, 20.0), ("d", 1, 0.0, 0.0, 20.0, 20.0), ("d", 2, 9.0, 9.0, 20.0, 20.0)], box)
    assert pdf_lines.outside_tables(blocks, spark.createDataFrame([("d", 1, 10.0, 10.0, 50.0, 50.0)], box)).count() == 2
    images = spark.createDataFrame([("d", 5, 2, 1.0, 300, 10), ("d", 5, 1, 1.0, 300, 10), ("d", 6, 1, 1.0, 199, 199)], "doc string, xref int, page int, y double, width int, height int")
    assert rows(pdf_lines.figures(images).select("xref", "page")) == [(5, 1)]
    t = spark.range(1).select(pdf_lines.table_html(F.array(F.array(F.lit("a")), F.array(F.lit("1")))).alias("t")).first()["t"]
    assert t == "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"


def test_links(spark):
    h = spark.createDataFrame([("1", 0, "https://www.ema.europa.eu/x/product-information/a_en.pdf"), ("1", 1, " https://www.ema.europa.eu/x/product-information/a_fr.pdf "), ("2", 0, "https://www.ema.europa.eu/x/report_fr.pdf")], "key string, ord int, href string")
    assert rows(pages.information_link(h)) == [("1", "https://www.ema.europa.eu/x/product-information/a_fr.pdf")]
    r = spark.createDataFrame([(0, "product-information", "Abilify ", "u0", {}), (1, "product-information", "ABILIFY", "u1", {"fr": "f"}), (2, "other", "X", "u", {}), (3, "product-information", "Y", "u3", {"fr": "f3"})], "ord int, type string, medicine_name string, document_url string, translations map<string,string>")
    assert rows(pages.product_index(r)) == [("abilify", "u0"), ("y", "f3")]
    d = spark.createDataFrame([("", "NOM X 5 mg", "é a")], "s string, n string, t string")
    assert d.select(pages.search_links({"a": "http://a?q={q}"}, F.col("s"), F.col("n")).alias("m")).first()["m"] == {"a": "http://a?q=nom+x"}
    assert d.select(pages.pdf_target(F.col("s"), F.lit("l"), F.col("n"), "s?")).first()[0] == "l"


def test_structured_data_cannot_leave_its_script(spark):
    d = spark.createDataFrame([("/p", "</script>", "x", "", "", "2024-01-01")], "p string, n string, d string, s string, h string, r string")
    j = d.select(pages.drug_json("https://x", *map(F.col, "pndshr")).alias("j")).first()["j"]
    assert "<" not in j
    g = json.loads(j)["@graph"]
    assert g[0] == {"@type": "Drug", "@id": "https://x/p#drug", "name": "</script>", "url": "https://x/p"} and g[1]["lastReviewed"] == "2024-01-01"
    trail = F.array(F.struct(F.lit("A").alias("label"), F.lit("/").alias("path")), F.struct(F.lit("B&").alias("label"), F.lit("/b").alias("path")))
    assert json.loads(d.select(pages.breadcrumb_json("https://x", trail)).first()[0])["itemListElement"][1] == {"@type": "ListItem", "position": 2, "name": "B&", "item": "https://x/b"}
    assert d.select(pages.breadcrumb(trail)).first()[0] == '<ol><li><a href="/">A</a></li><li aria-current="page">B&amp;</li></ol>'
    assert d.select(pages.date_banner(F.col("r"), F.lit(True))).first()[0] == '<p class="asof">Document archivé, version du 1er janvier 2024</p>'


def test_reading_order_of_lines_tables_and_figures(spark):
    from folio.operators import pdf_lines

    box = lambda y: (50.0, y, 500.0, y + 20.0)
    lines = [
        ("d", 1, 1, 1, *box(50.0), "1", False), ("d", 1, 2, 1, *box(60.0), "before any group", False),
        ("d", 1, 3, 1, *box(100.0), "ANNEXE I", True), ("d", 1, 4, 1, *box(120.0), "RÉSUMÉ DES CARACTÉRISTIQUES", True),
        ("d", 1, 5, 1, *box(150.0), "4.", True), ("d", 1, 6, 1, *box(300.0), "DONNÉES <x>", False), ("d", 1, 6, 2, *box(300.0), "a first line", False), ("d", 1, 6, 3, *box(300.0), "and a second", False), ("d", 1, 6, 4, *box(300.0), " ", False),
        ("d", 1, 7, 1, *box(400.0), "4.1", True), ("d", 2, 1, 1, *box(95.0), "Indications", False), ("d", 2, 2, 1, *box(210.0), "within the table", False),
        ("d", 2, 3, 1, *box(300.0), "5.", True), ("d", 2, 4, 1, *box(400.0), "no title, as a table came", False), ("d", 2, 5, 1, *box(500.0), "B.", True), ("d", 2, 6, 1, *box(600.0), "NOTICE", False), ("d", 2, 7, 1, *box(700.0), "2", False),
    ]
    tables = [("d", 2, 49.0, 209.0, 501.0, 231.0, [["h", "i"], ["1", None]]), ("d", 2, 0.0, 350.0, 9.0, 360.0, [["t"]])]
    images = [("d", 1, 200.0, 7, 300, 10, "u'\""), ("d", 2, 10.0, 7, 300, 300, "again"), ("d", 2, 20.0, 8, 10, 10, "small")]
    make = spark.createDataFrame
    rows = pdf_lines.reading_order(
        make(lines, "doc string, page int, block int, line int, x0 double, y0 double, x1 double, y1 double, text string, bold boolean"), make(tables, "doc string, page int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"), make(images, "doc string, page int, y double, xref int, width int, height int, src string")
    )
    got = [(r["kind"], r["grp"], r["sid"], r["label"]) for r in rows.orderBy("ord").collect()]
    assert got == [
        ("text", 0, None, "before any group"), ("group", 1, None, "ANNEXE I"), ("group", 1, None, "RÉSUMÉ DES CARACTÉRISTIQUES"), ("figure", 1, None, None), ("heading1", 1, "sec-1", "4. DONNÉES <x>"),
        ("text", 1, None, "a first line and a second"), ("heading2", 1, None, "4.1 Indications"), ("table", 1, None, None), ("table", 1, None, None), ("text", 1, None, "no title, as a table came"), ("group", 2, None, "B. NOTICE"), ("text", 2, None, "2"),
    ]
    html, toc = pdf_lines.assembled(rows).select("html", "toc").first()
    assert html == (
        '<div id="textDocument"><details class="ema-annexe"><summary id="grp-1">Document</summary><p>before any group</p></details>'
        '<details class="ema-annexe" open><summary id="grp-2">ANNEXE I - RÉSUMÉ DES CARACTÉRISTIQUES</summary><figure><img src="u\'&quot;" alt=""></figure><h2 class="AmmAnnexeTitre1" id="sec-1">4. DONNÉES &lt;x&gt;</h2>'
        '<p>a first line and a second</p><h3 class="AmmAnnexeTitre2">4.1 Indications</h3><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td></td></tr></table><table><tr><th>t</th></tr></table><p>no title, as a table came</p></details>'
        '<details class="ema-annexe"><summary id="grp-3">B. NOTICE</summary><p>2</p></details></div>'
    )
    assert [(t["sid"], t["label"], [tuple(s) for s in t["subs"]]) for t in toc] == [("grp-1", "Document", []), ("grp-2", "ANNEXE I - RÉSUMÉ DES CARACTÉRISTIQUES", [("sec-1", "4. DONNÉES <x>")]), ("grp-3", "B. NOTICE", [])]
    none = rows.limit(0)
    assert pdf_lines.assembled(none).count() == 0
