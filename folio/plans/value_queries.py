"""Values, outputs, queues and structures of the catalog over the driver's tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import central, entities, freshness, html_blocks, incremental, lanes, pages, pdf_lines
from folio.plans.catalog_queries import Query, read
from folio.sources import catalog

_NOW = "2024-01-08 00:00:00"


def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as notices, files and manifests write them; every tenth does not exist, every tenth is missing."""
    day = F.to_date("o_orderdate")
    notice = F.when(F.col("o_orderkey") % 10 == 0, "le 31/02/2020").when(F.col("o_orderkey") % 10 == 1, "sans date").otherwise(F.concat(F.lit("mis à jour le "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(", puis 1/1/2030")))
    changed = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("101010")))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", X.first_dmy_date(notice).alias("noted"), X.packed_date(changed, F.lit("D:20010203")).alias("packed"), X.long_date(iso).alias("long"),
        X.last_modified(F.concat(iso, F.lit("T10:00:00"))).alias("lastmod"), day.cast("string").alias("day"),
    )


def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F8, F10, F11, F13, F14, F18, FP8: repairs, roots, paths, levels, signatures and filler of part names."""
    n, size = F.col("p_name"), F.col("p_size")
    c1 = F.concat(F.lit("\x93"), n, F.lit("\x94\x81 \x80"))
    name = F.concat(F.when(size % 5 == 0, "5x ").otherwise(""), n, F.lit(", "), size.cast("string"), F.lit(" mg"))
    para = F.when(size % 4 == 0, " Sans objet. ").when(size % 4 == 1, "A compléter ultérieurement par le titulaire").when(size % 4 == 2, n).otherwise(F.concat(n, F.lit(" is a whole sentence")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", X.repair_cp1252(c1).alias("repaired"), X.brand_root(name).alias("root"), X.heading_path(F.col("p_brand"), F.when(size % 2 == 0, ""), F.col("p_type")).alias("path"),
        X.heading_level(F.when(size % 2 == 0, F.concat(F.lit("x AmmAnnexeTitre"), (size % 7).cast("string"))).otherwise("y")).alias("level"),
        X.looks_like_pdf(F.concat(F.when(size % 3 == 0, "%PDF-1.4 ").otherwise(" %PDF-"), n).cast("binary")).alias("pdf"),
        X.is_filler(para).alias("filler"), X.trimmed_fold(F.concat(F.lit("  É"), n, F.lit(" "))).alias("folded"), F.array_join(X.fold_words(F.concat(n, F.lit(" ÉTÉ ab"))), " ").alias("words"),
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("key")).agg(F.max("t").alias("last_fetch"), F.max_by("event_type", F.struct("t", "event_id")).alias("status"))


def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK1, TK2, J19: of the users with an even id that are due, the first sixty by score and place."""
    r = _users(spark, sf_dir)
    keys = r.select("key", (F.col("key") % 5).cast("double").alias("score"), F.col("key").alias("file_order"))
    return freshness.crawl_queue(keys, r, F.lit(_NOW).cast("timestamp"), 1, 60, r.filter("key % 2 = 0"))


def rotating_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: the ten suppliers from a cursor near the end on, going round."""
    q = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("pos"))
    return freshness.rotation(q, 7, 10)


def idle_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, D8, ST7: seconds until the first user expires."""
    return freshness.next_expiry(_users(spark, sf_dir).filter("key % 2 = 0"), F.lit(_NOW).cast("timestamp"), 8 * 86400).select(F.round("wait", 3).alias("wait"))


def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16, M6: an index of 5,000 pages a minute against suppliers as lanes."""
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).cast("double").alias("ppm"), (F.col("s_nationkey") % 2 == 0).alias("enabled"), (F.col("s_suppkey") % 3 == 0).alias("idle"))
    return freshness.catch_up(s, F.lit(5000.0), F.lit(1000.0)).select("net", F.round("eta_s", 6).alias("eta_s"))


def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6: fixed pages, letters of suppliers' and parts' names, and documents of every other id as full pages."""
    d, s, p = (read(spark, sf_dir, t) for t in ("documents", "supplier", "part"))
    letters = incremental.letter_counts(s.select(F.col("s_name").alias("name")).union(p.select("p_name")).union(p.filter("p_size = 1").select(F.lit("42"))))
    ps = d.select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "2024-05-06T01:02:03").when(F.col("doc_id") % 3 == 1, "").alias("asof"), (F.col("doc_id") % 2 == 0).alias("full"))
    return incremental.sitemap("https://x", ["/", "/about"], letters, ps)


def browse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, TK4: keys of each letter in order of the folded name."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "1 É").otherwise(""), F.initcap("p_name")).alias("name"))
    return incremental.browse(p).select("letter", "n", F.array_join("keys", ",").alias("keys"))


def kept_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK10, SC14: rendered files of pages that still exist."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    files = d.select(F.concat(F.lit("/out/rcp/"), F.col("doc_id").cast("string"), F.lit("-x.html")).alias("path"))
    return incremental.prune(catalog.page_keys(files).withColumnRenamed("key", "slug"), l.select(F.col("doc_id").cast("string").alias("slug")))


def vectors_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP9, FP10, J15, ST12: documents whose vectors are stale by content, and whether a later pass takes them as new enough."""
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    p = d.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 4).cast("string").alias("src_hash"), (F.col("doc_id") % 9).alias("mtime"))
    v = e.select(F.col("vec_id").alias("key"), (F.col("vec_id") % 2).cast("string").alias("src_hash"), F.when(F.col("vec_id") % 6 == 0, "old").otherwise("m").alias("model"), F.when(F.col("vec_id") % 8 == 1, 0).when(F.col("vec_id") % 8 == 5, 8).otherwise(64).alias("dim"), (F.col("vec_id") % 10).alias("v_mtime"))
    late, first = (incremental.fresh_by_time(p, v, "m", 64, b).withColumn(n, F.lit(True)) for b, n in ((False, "late"), (True, "early")))
    out = incremental.stale_vectors(p, v, "m", 64).join(late, "key", "left").join(first, "key", "left")
    return out.select("key", F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("early", F.lit(False)).alias("early"))


def bold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20: order lines as spans of a document's lines."""
    l = read(spark, sf_dir, "lineitem")
    spans = l.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), (F.col("l_linenumber") % 2).alias("y"), F.lit(0).alias("line"), F.col("l_partkey").alias("ord"), F.when(F.col("l_tax") < 0.02, " ").otherwise(F.col("l_returnflag")).alias("text"), (F.col("l_linestatus") == "F").alias("bold"))
    return pdf_lines.lines_of(spans).select("doc", "y", "text", "bold")


def figure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP20, W12: order lines as images; each once a document, small ones left out."""
    l = read(spark, sf_dir, "lineitem")
    images = l.select(F.col("l_partkey").alias("doc"), (F.col("l_suppkey") % 3).alias("xref"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("y"), (F.col("l_quantity") * 5).alias("width"), (F.col("l_extendedprice") / 300).alias("height"))
    return pdf_lines.figures(images).select("doc", "xref", "page", "y")


def text_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes that no box of their supplier holds, two points aside."""
    l, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    x, y = F.col("l_quantity"), F.col("l_partkey") % 90
    boxes = l.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 5).alias("y1"))
    tables = s.select(F.col("s_suppkey").alias("doc"), (F.col("s_suppkey") % 7 + 1).cast("int").alias("page"), F.lit(10.0).alias("x0"), F.lit(20).alias("y0"), F.lit(50.0).alias("x1"), F.lit(80).alias("y1"))
    return pdf_lines.outside_tables(boxes, tables).select("l_orderkey", "l_linenumber", "doc", "x0", "y0")


def paged_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO9, DO11: a numbered marker waits for its title, dividers open groups; events as lines of a user's document."""
    e = read(spark, sf_dir, "events")
    n = F.row_number().over(html_blocks.W.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.lit(100).alias("y"), n.alias("line"), "event_type")
    text = F.when(F.col("line") % 5 == 1, "4.").when(F.col("line") % 5 == 4, "4.1").when(F.col("line") % 11 == 3, "ANNEXE II").otherwise(F.col("event_type"))
    lines = rows.select("doc", "page", "y", "line", text.alias("text"), ((F.col("line") % 5).isin(1, 4) | (F.col("line") % 11 == 3)).alias("bold"))
    return pdf_lines.structure(lines).select("doc", F.col("ord").cast("long").alias("ord"), "kind", F.col("grp").cast("long").alias("grp"), "sid", "label")


def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, W3, DO4: order lines as headings of an order's document, with their parents."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = l.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ord"), F.lit("heading").alias("kind"), (F.col("p") % 3 + 1).alias("level"), F.when(F.col("p") % 10 == 0, F.concat(F.lit("own-"), F.col("p").cast("string"))).otherwise("").alias("id"), F.when(F.col("p") % 7 == 0, "").otherwise(F.concat(F.lit("t"), F.col("p").cast("string"))).alias("text"))
    return html_blocks.table_of_contents(rows)


def part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9, F19: parts by number, or by brand root where there is none."""
    p = read(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg")).alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("EU/1/00/"), F.col("p_size").cast("string"))).otherwise("").alias("eu"))
    return entities.authorization_groups(e).select("auth", F.array_join("members", ",").alias("members"))


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP14, FP19, U1: the document a page points to and where readers may search further."""
    p = read(spark, sf_dir, "part")
    host = F.when(F.col("p_size") % 4 == 0, "https://other/").otherwise(" https://www.ema.europa.eu/")
    href = F.concat(host, F.lit("Product-Information/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 7 == 0, "_FR.pdf ").when(F.col("p_size") % 3 == 0, ".html").otherwise("_en.PDF"))
    link = pages.information_link(p.select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"), href.alias("href"))).withColumnRenamed("key", "p_brand")
    sites = pages.search_links({"a": "https://a/?q={q}", "b": "https://b/{q}/x"}, F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.concat("p_name", F.lit(", 5 mg")))
    target = pages.pdf_target(F.when(F.col("p_size") % 5 == 0, "https://baked"), F.when(F.col("p_size") % 3 == 0, F.col("href")), F.concat("p_name", F.lit(", 5 mg")), "https://s/?q=")
    return p.join(link, "p_brand", "left").select("p_partkey", target.alias("target"), sites["a"].alias("a"), sites["b"].alias("b"))


def brand_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP13, AG10: the first product information of each brand, French before the original."""
    p = read(spark, sf_dir, "part")
    fr = F.create_map(F.lit("fr"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("fr/"), F.col("p_name"))).otherwise(""))
    r = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 3 == 0, "other").otherwise("product-information").alias("type"), F.concat(F.lit(" "), F.upper("p_type")).alias("medicine_name"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("en/"), "p_name")).alias("document_url"), fr.alias("translations"))
    return pages.product_index(r)


def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS1, JS2, DO13: what search engines read of a part's page, its path and its date."""
    n = F.concat(F.lit("<b>"), "p_name")
    path = F.concat(F.lit("/rcp/"), F.col("p_partkey").cast("string"))
    trail = F.array(F.struct(F.lit("A & B").alias("label"), F.lit("/").alias("path")), F.struct(n.alias("label"), path.alias("path")))
    even = F.col("p_size") % 2 == 0
    drug = pages.drug_json("https://x", path, n, F.lit("d"), F.when(even, F.col("p_type")), F.when(~even, F.lit("h")).otherwise(""), F.when(even, "2024-05-06"))
    return read(spark, sf_dir, "part").select("p_partkey", drug.alias("drug"), pages.breadcrumb_json("https://x", trail).alias("crumbs"), pages.breadcrumb(trail).alias("trail"), pages.site_json("https://x", "X").alias("site"), pages.date_banner(F.when(even, "2024-05-01T01:02"), F.col("p_size") % 4 == 0).alias("banner"))


def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, DO13: distinct kinds of a user's events in order of the first, as a list of links."""
    e = read(spark, sf_dir, "events")
    targets = entities.linked_targets(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("target"), F.col("event_id").alias("ord")))
    names = e.select(F.col("event_type").alias("slug")).distinct().filter("slug <> 'error'").withColumn("name", F.concat(F.lit("<"), "slug", F.lit(">")))
    return pages.related(targets, names)


def asked_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK2, SO6: users of an explicit list, each once where it came first, and the address of those whose document came from an archive."""
    e = read(spark, sf_dir, "events")
    asked = lanes.explicit_queue(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos")))
    again = central.archive_retries(e.select(F.col("user_id").alias("key"), (F.col("event_type") == "error").alias("via_archive")), asked.select("key", F.concat(F.lit("u/"), F.col("key").cast("string")).alias("url")))
    return asked.join(again, "key", "left").select("key", "pos", "url")


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, SC4, AG1, AG2: parts as composition rows by brand: how many links, which tokens."""
    p = read(spark, sf_dir, "part")
    cells = F.array(F.concat(F.lit(" "), "p_brand"), F.lit(""), F.lit(""), F.col("p_name"), F.lit(""), F.lit(""), F.lit("SA"), (F.col("p_size") % 3).cast("string"))
    rows = p.select(F.when(F.col("p_size") % 4 == 0, F.slice(cells, 1, 5)).otherwise(cells).alias("cells"))
    keep = p.filter("p_size > 10").select(F.col("p_brand").alias("key"))
    short = catalog.column_tokens(rows, 0, 3, keep).select("key", F.array_join(F.array_sort("tokens"), " ").alias("all_tokens"))
    return catalog.composition(rows, keep).join(short, "key").select("key", "n_links", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), "all_tokens")


def filled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO12, DO15, F13: a page from a template, with a table of cells."""
    p = read(spark, sf_dir, "part")
    cells = F.array(F.array(F.lit("Name"), F.lit("Size")), F.array(X.html_escape(F.concat(F.lit("<"), "p_name")), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))))
    body = incremental.fill(F.lit("<h1>{{title}}</h1>{{body}}{{note}}"), title=F.col("p_name"), body=pdf_lines.table_html(cells), note=F.when(F.col("p_size") % 3 == 0, "n"))
    return p.select("p_partkey", body.alias("html"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        date_values, text_repairs, crawl_order, rotating_crawl, idle_wait, catch_up, site_map, browse_pages, kept_outputs, vectors_to_make, bold_lines, figure_list, text_outside_tables,
        paged_structure, heading_tree, part_groups, page_targets, brand_documents, structured_data, related_pages, asked_first, compositions, filled_pages,
    )
}

_USERS = "SELECT user_id AS key, max(ts) AS t, arg_max(event_type, (ts, event_id)) AS st FROM events GROUP BY user_id"
_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "date_values": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 1) THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS noted, CASE WHEN o_orderkey % 3 = 0 THEN '2001-02-03' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS packed,
      CASE WHEN day(o_orderdate) = 1 THEN '1er' ELSE day(o_orderdate)::VARCHAR END || ' ' || ['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'][month(o_orderdate)] || ' ' || year(o_orderdate) AS long,
      strftime(o_orderdate, '%Y-%m-%d') AS lastmod, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "text_repairs": """SELECT p_partkey, chr(8220) || p_name || chr(8221) || ' ' || chr(8364) AS repaired, CASE WHEN p_size % 5 = 0 THEN '5x ' || p_name || ' ' || p_size || ' mg' ELSE p_name END AS root,
      p_brand || ' > ' || p_type AS path, CASE WHEN p_size % 2 = 0 THEN p_size % 7 END::INT AS level, p_size % 3 = 0 AS pdf,
      p_size % 4 IN (0, 1) OR (p_size % 4 = 2 AND (len(string_split(p_name, ' ')) <= 2 OR length(p_name) <= 5)) AS filler, 'e' || lower(p_name) AS folded,
      array_to_string(list_filter(string_split(lower(p_name) || ' ete ab', ' '), lambda w: length(w) >= 3), ' ') AS words FROM part""",
    "crawl_order": f"""WITH r AS ({_USERS}) SELECT key, (key % 5)::DOUBLE AS score FROM r WHERE key % 2 = 0 AND (st = 'error' OR floor((epoch_us(TIMESTAMP '{_NOW}') - epoch_us(t)) / 86400000000) >= 1) ORDER BY key % 5 DESC, key LIMIT 60""",
    "rotating_crawl": "SELECT s_name AS key, s_suppkey AS pos FROM supplier, (SELECT count(*) AS n FROM supplier) ORDER BY (((s_suppkey - 7) % n) + n) % n LIMIT 10",
    "idle_wait": f"WITH r AS ({_USERS}) SELECT round(least(greatest(coalesce(min(691200 - (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(t)) / 1e6), 3600.0), 1.0), 3600.0), 3) AS wait FROM r WHERE key % 2 = 0",
    "catch_up": """WITH c AS (SELECT 5000.0::DOUBLE - coalesce(sum((s_suppkey % 7)::DOUBLE) FILTER (s_nationkey % 2 = 0 AND s_suppkey % 3 <> 0), 0.0) AS net FROM supplier) SELECT net, CASE WHEN net > 0 THEN round(1000.0 / net * 60, 6) END AS eta_s FROM c""",
    "site_map": """SELECT 'https://x' || unnest(['/', '/about']) AS loc, NULL::VARCHAR AS lastmod
      UNION ALL SELECT DISTINCT 'https://x/browse/' || l, NULL FROM (SELECT 's' AS l FROM supplier UNION ALL SELECT lower(left(p_name, 1)) FROM part UNION ALL SELECT 'num' FROM part WHERE p_size = 1)
      UNION ALL SELECT 'https://x/d/' || doc_id, CASE WHEN doc_id % 3 = 0 THEN '2024-05-06' END FROM documents WHERE doc_id % 2 = 0""",
    "browse_pages": """WITH n AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN '1 e' || lower(p_name) ELSE lower(p_name) END AS k FROM part)
      SELECT upper(regexp_extract(k, '[a-z]')) AS letter, count(*) AS n, string_agg(key::VARCHAR, ',' ORDER BY k, key) AS keys FROM n GROUP BY 1""",
    "kept_outputs": "SELECT DISTINCT doc_id::VARCHAR AS slug FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "vectors_to_make": """WITH j AS (SELECT d.doc_id AS key, v.vec_id AS v, v.vec_id % 6 <> 0 AND v.vec_id % 8 <> 5 AS same, d.doc_id % 4 = v.vec_id % 2 AS content, v.vec_id % 10 >= d.doc_id % 9 AS newer FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id)
      SELECT key, coalesce(newer, false) AS late, coalesce(newer AND same, false) AS early FROM j WHERE NOT coalesce(content AND same, false)""",
    "bold_lines": """WITH s AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS y, l_partkey AS o, CASE WHEN l_tax < 0.02 THEN ' ' ELSE l_returnflag END AS t, l_linestatus = 'F' AS b FROM lineitem)
      SELECT doc, y, trim(string_agg(t, '' ORDER BY o, t)) AS text, coalesce(bool_and(b) FILTER (t <> ' '), true) AS bold FROM s GROUP BY doc, y""",
    "figure_list": """SELECT l_partkey AS doc, l_suppkey % 3 AS xref, l_linenumber AS page, l_orderkey AS y FROM lineitem WHERE l_quantity * 5 >= 200 OR l_extendedprice / 300 >= 200
      QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey % 3 ORDER BY l_linenumber, l_orderkey) = 1""",
    "text_outside_tables": """SELECT l_orderkey, l_linenumber, l_suppkey AS doc, l_quantity AS x0, l_partkey % 90 AS y0 FROM lineitem WHERE NOT (l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_linenumber = l_suppkey % 7 + 1 AND l_quantity >= 8 AND l_quantity <= 42 AND l_partkey % 90 BETWEEN 18 AND 77)""",
    "paged_structure": r"""WITH e AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type FROM events),
      l AS (SELECT doc, n, CASE WHEN n % 5 = 1 THEN '4.' WHEN n % 5 = 4 THEN '4.1' WHEN n % 11 = 3 THEN 'ANNEXE II' ELSE event_type END AS t FROM e),
      b AS (SELECT *, CASE WHEN lag(t) OVER w IN ('4.', '4.1') THEN lag(t) OVER w END AS m FROM l WINDOW w AS (PARTITION BY doc ORDER BY n)),
      k AS (SELECT doc, n, CASE WHEN m = '4.1' THEN 'heading2' WHEN m = '4.' AND t = 'ANNEXE II' THEN 'group' WHEN m = '4.' THEN 'heading1' WHEN t = 'ANNEXE II' THEN 'group' ELSE 'text' END AS kind, CASE WHEN m IS NOT NULL THEN m || ' ' || t ELSE t END AS label FROM b WHERE t NOT IN ('4.', '4.1')),
      o AS (SELECT *, kind = 'group' AND coalesce(lag(kind) OVER (PARTITION BY doc ORDER BY n) <> 'group', true) AS opens FROM k)
      SELECT doc, row_number() OVER w AS ord, kind, (count(*) FILTER (opens) OVER w)::BIGINT AS grp, CASE WHEN kind = 'heading1' THEN 'sec-' || (count(*) FILTER (kind = 'heading1') OVER w) END AS sid, label FROM o WINDOW w AS (PARTITION BY doc ORDER BY n)""",
    "heading_tree": """WITH l AS (SELECT l_orderkey AS key, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem GROUP BY ALL), h AS (SELECT key, ord, p % 3 + 1 AS level, p FROM l WHERE p % 7 <> 0 AND p % 3 < 2),
      n AS (SELECT key, ord, level, 't' || p AS title, CASE WHEN p % 10 = 0 THEN 'own-' || p WHEN level = 1 THEN 'sec-' || (count(*) FILTER (level = 1) OVER w - 1) ELSE 'sub-' || (count(*) FILTER (level <> 1) OVER w - 1) END AS id FROM h WINDOW w AS (PARTITION BY key ORDER BY ord))
      SELECT key, ord, id, level, title, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM n""",
    "part_groups": "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'EU/1/00/' || p_size ELSE p_name END AS auth, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1",
    "page_targets": """WITH h AS (SELECT p_brand, p_partkey, p_size, 'https://www.ema.europa.eu/Product-Information/' || p_partkey || CASE WHEN p_size % 7 = 0 THEN '_FR.pdf' ELSE '_en.PDF' END AS href FROM part WHERE p_size % 4 <> 0 AND (p_size % 7 = 0 OR p_size % 3 <> 0)),
      l AS (SELECT p_brand, arg_min(href, (CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END, p_partkey)) AS href FROM h GROUP BY p_brand), q AS (SELECT *, replace(p_name, ' ', '+') AS r, replace(lower(CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END), ' ', '+') AS s FROM part)
      SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'https://baked' ELSE coalesce(CASE WHEN p_size % 3 = 0 THEN href END, 'https://s/?q=' || r) END AS target, 'https://a/?q=' || s AS a, 'https://b/' || s || '/x' AS b FROM q LEFT JOIN l ON q.p_brand = l.p_brand""",
    "brand_documents": """SELECT lower(p_type) AS brand, arg_min(CASE WHEN p_size % 2 = 0 THEN 'fr/' || p_name ELSE 'en/' || p_name END, p_partkey) AS url FROM part WHERE p_size % 3 <> 0 AND (p_size % 2 = 0 OR p_size % 5 > 0) GROUP BY 1""",
    "structured_data": r"""WITH p AS (SELECT p_partkey, p_type, p_size, '\u003cb>' || p_name AS n, '&lt;b&gt;' || p_name AS e, '/rcp/' || p_partkey AS u, p_size % 2 = 0 AS even FROM part)
      SELECT p_partkey, '{"@context":"https://schema.org","@graph":[{"@type":"Drug","@id":"https://x' || u || '#drug","name":"' || n || '","url":"https://x' || u || '"' || CASE WHEN even THEN ',"activeIngredient":"' || p_type || '"' ELSE ',"manufacturer":{"@type":"Organization","name":"h"}' END
        || '},{"@type":"MedicalWebPage","@id":"https://x' || u || '","url":"https://x' || u || '","name":"' || n || ' - RCP","description":"d","inLanguage":"fr","mainEntity":{"@id":"https://x' || u || '#drug"}' || CASE WHEN even THEN ',"lastReviewed":"2024-05-06"' ELSE '' END || '}]}' AS drug,
      '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"A & B","item":"https://x/"},{"@type":"ListItem","position":2,"name":"' || n || '","item":"https://x' || u || '"}]}' AS crumbs,
      '<ol><li><a href="/">A &amp; B</a></li><li aria-current="page">' || e || '</li></ol>' AS trail,
      '{"@context":"https://schema.org","@type":"WebSite","name":"X","url":"https://x/","potentialAction":{"@type":"SearchAction","target":"https://x/?q={search_term_string}","query-input":"required name=search_term_string"}}' AS site,
      CASE WHEN NOT even THEN '' WHEN p_size % 4 = 0 THEN '<p class="asof">Document archivé, version du 1er mai 2024</p>' ELSE '<p class="asof">Version du 1er mai 2024</p>' END AS banner FROM p""",
    "related_pages": """WITH f AS (SELECT user_id AS key, event_type AS t, min(event_id) AS o FROM events WHERE event_type <> 'error' GROUP BY ALL)
      SELECT key, '<ul>' || string_agg('<li><a href="/rcp/' || t || '">&lt;' || t || '&gt;</a></li>', '' ORDER BY o) || '</ul>' AS html FROM f GROUP BY key""",
    "asked_first": "SELECT user_id AS key, min(event_id) AS pos, CASE WHEN bool_or(event_type = 'error') THEN 'u/' || user_id END AS url FROM events GROUP BY user_id",
    "compositions": f"""WITH r AS (SELECT p_brand AS key, p_size, {_WORDS.format('p_name')} AS w FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 10))
      SELECT key, count(DISTINCT p_size % 3) FILTER (p_size % 4 <> 0) AS n_links, array_to_string(list_sort(list_distinct(flatten(list(w) FILTER (p_size % 4 <> 0)))), ' ') AS tokens, array_to_string(list_sort(list_distinct(flatten(list(w)))), ' ') AS all_tokens
      FROM r GROUP BY key HAVING count(*) FILTER (p_size % 4 <> 0) > 0""",
    "filled_pages": """SELECT p_partkey, '<h1>' || p_name || '</h1><table><tr><th>Name</th><th>Size</th></tr><tr><td>&lt;' || p_name || '</td><td>' || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END || '</td></tr></table>' || CASE WHEN p_size % 3 = 0 THEN 'n' ELSE '' END AS html FROM part""",
}
