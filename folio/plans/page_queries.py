"""More of the catalog's operators over the driver's tables: central entries, links, hashes, lanes, pages; with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.vectors import pack, quantize, unpack
from folio.operators import articles, central, html_blocks, incremental, lanes, pages, retrieval
from folio.plans.catalog_queries import _Q, Query, read
from folio.sources import catalog


def _supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    third = F.pmod("s_suppkey", F.lit(4))
    proc = F.when(third == 0, "Procédure centralisée").when(third == 1, "Procédure décentralisée").when(third == 2, F.concat(F.lit("no EU/1/"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(" x"))).otherwise("")
    return s.select(F.array(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")), "s_name", proc, F.concat(F.lit(" Holder "), F.col("s_nationkey").cast("string"))).alias("cells"), F.col("s_suppkey").alias("file_order"))


def central_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP3, FP4: suppliers with an EU number or the central procedure in a cell, and the cell after the number."""
    return central.central_entries(_supplier_cells(spark, sf_dir))


def _group_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    eu = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.lit("EU/1/00/"), F.col("p_size").cast("string"))).otherwise("")
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("key"), F.col("p_name").alias("name"), eu.alias("eu"))


def seeded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, AG9, F19: one part of each group without a link gets the address of the colour its name begins with."""
    e = _group_entries(spark, sf_dir)
    links = e.filter(F.pmod(F.col("key").cast("long"), F.lit(31)) == 0).select("key", F.lit("u").alias("url"))
    p = read(spark, sf_dir, "part")
    index = p.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("brand")).agg(F.min("p_partkey").alias("ord")).select("brand", F.concat(F.lit("https://"), "brand").alias("url"), "ord")
    return central.seed_links(e, links, index)


def crawl_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20, SO4: parts whose group has a linked or rendered member."""
    e = _group_entries(spark, sf_dir)
    n = F.col("key").cast("long")
    return central.crawl_targets(e, e.filter(F.pmod(n, F.lit(97)) == 1), e.filter(F.pmod(n, F.lit(89)) == 3))


def baked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO10, SC22: facts put on a document's wrapper and read back."""
    p = read(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("<body>"), F.when(F.col("page_id") % 5 == 0, "<div>").otherwise('<div id="textDocument">'), F.col("url"), F.lit("</div>")))
    out = pages.bake(F.col("html"), F.lit("2024-01-02"), F.when(F.col("page_id") % 2 == 0, "2024-05-06"), F.col("url"), F.col("page_id") % 3 == 0)
    return p.select("page_id", out.alias("html")).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("hash"), pages.baked(F.col("html")).alias("b")).select("page_id", "hash", "b.*")


def vector_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT3, B1, SK8, SC23: vectors of one label as a page's chunks; codes packed, and read back from the JSON."""
    e = read(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("label").alias("key"), F.col("vec_id").alias("ord"), F.concat(F.lit("sec-"), F.col("vec_id").cast("string")).alias("sec"), F.lit("s").alias("snippet"), quantize(F.col("embedding")).alias("q"), F.lit("h").alias("src_hash"))
    out = incremental.payloads(chunks, "m", "query: ")
    meta = catalog.vector_meta(out)
    parsed = F.from_json("payload", "chunks array<struct<sec:string,q:string>>")["chunks"]
    firsts = out.select("key", F.size(parsed).cast("long").alias("n"), parsed[0]["sec"].alias("first_sec"), parsed[0]["q"].alias("first_q"), F.aggregate(unpack(parsed[0]["q"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("first_sum"))
    return firsts.join(meta.select("key", "model", "dim"), "key")


def page_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H4: hashes of full pages and of stubs, and of a page's raw text."""
    p = read(spark, sf_dir, "pages")
    kind = F.col("page_id") % 2 == 0
    key = F.when(kind, X.page_hash("full", F.col("html"), F.col("url"))).otherwise(X.page_hash("stub", F.col("url")))
    return p.select("page_id", key.alias("page_hash"), X.content_hash(F.col("html")).alias("raw_hash"))


def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, D6, M7, FP15: ages, durations and percentages as readers see them."""
    o = read(spark, sf_dir, "orders")
    days, secs, score = F.datediff(F.lit("1999-01-01"), F.to_date("o_orderdate")), F.col("o_totalprice") * 2, F.col("o_totalprice") / 400_000
    return o.select("o_orderkey", X.human_age(days).alias("age"), X.is_old_copy(days).alias("old"), X.dhm(secs).alias("dhm"), X.two_units(secs).alias("two"), X.hms(secs).alias("hms"), X.percent(score).alias("pct"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a search engine shows of parts."""
    p, sub = read(spark, sf_dir, "part"), F.when(F.col("p_size") > 20, F.col("p_type"))
    return p.select("p_partkey", pages.description(F.col("p_name"), sub).alias("national"), pages.central_description(F.col("p_name"), F.col("p_size") % 2 == 0).alias("central"))


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3, J12, SK4: parts and suppliers in one index, withdrawn ones marked."""
    p, s = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    a = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"), X.slug(F.col("p_name")).alias("slug"), F.col("p_type").alias("sub"))
    b = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"), X.slug(F.col("s_name")).alias("slug"))
    return incremental.search_rows(a, b, a.filter("key LIKE '%7'")).select("key", "name", "eu", "ret", "line")


def index_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the date and kind that a manifest has for some of them."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    m = l.select(F.col("doc_id").alias("key"), F.concat(F.lit("2024-01-0"), F.col("quality").cast("string")).alias("asof"), (F.col("toxic") == 0).alias("full"))
    return incremental.with_dates(d.select(F.col("doc_id").alias("key"), "source"), m)


def stub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO14: bodies of pages that only point to a document."""
    s = read(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    body = pages.stub_body(F.col("s_name"), F.when(n % 2 == 0, F.concat(F.lit("EU/1/00/"), n.cast("string"))), F.when(n % 3 == 0, "A & B"), F.when(n % 5 == 0, "ring"), F.when(n % 2 == 1, "https://x/?a=1&b=2"), "https://search/?q=")
    return s.select("s_suppkey", body.alias("body"))


def lane_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, ST6, ST9: users as pages of two lanes, what is due in each and what a forced pass has left."""
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    keys = e.select(F.col("user_id").alias("key")).distinct()
    routed = lanes.lane_of(keys, keys.filter("key % 3 = 0"))
    records = e.groupBy(F.col("user_id").alias("key")).agg(F.max("t").alias("last_fetch"), F.max_by("event_type", F.struct("t", "event_id")).alias("status"))
    order = routed.filter("lane = 'rcp'").select("key", F.col("key").alias("pos"))
    forced = lanes.forced_left(order, keys.filter("key % 2 = 0")).select(F.lit("rcp").alias("lane"), "key")
    table = spark.createDataFrame([("eu", True, 1, 300.0), ("rcp", True, 3, 4.0)], "lane string, enabled boolean, ttl_days int, rate double")
    return lanes.lane_gauges(routed, records, forced, table, F.lit("2024-01-08 00:00:00").cast("timestamp"))


def embedding_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11, AG13: first arrivals in the order they are taken, readers past the cap, and how many of each source wait."""
    e = read(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "purchase", "user").when(F.col("event_type") == "click", "crawl").otherwise("sweep")
    q = lanes.priority_queue(e.select(F.col("user_id").alias("key"), source.alias("source"), F.col("event_id").alias("at")), 60)
    return q.join(F.broadcast(lanes.pending_by_source(q)), "source").select("key", "source", "at", "n")


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13, RT4: what a reader is told of each document's vectors."""
    d, l, v = (read(spark, sf_dir, t) for t in ("documents", "labels", "embeddings"))
    k = d.select(F.col("doc_id").alias("key"))
    return lanes.readiness(k, k.filter("key % 10 <> 9"), l.select(F.col("doc_id").alias("key")), v.select(F.col("vec_id").alias("key")), k.filter("key % 4 = 0"), 10, 10)


def lane_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16, AG12: counters of outcomes and sources, which add up."""
    e = read(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "empty").otherwise("ok")
    source = F.when(F.col("user_id") % 3 == 0, "user").when(F.col("user_id") % 3 == 1, "auto").otherwise("crawl")
    return lanes.totals(e.select((F.col("user_id") % 2).alias("lane"), source.alias("source"), outcome.alias("outcome"), "ts"))


def substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5, F12, AG6: active substances of each brand, cleaned, each once in order."""
    p = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, " SA ").otherwise("FT")
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " (x, y)").when(F.col("p_size") % 3 == 1, ", z").otherwise(" SODIQUE"))
    cells = F.array(F.col("p_brand"), F.lit(""), F.lit(""), name, F.lit(""), F.lit(""), kind, F.lit("1"))
    return catalog.search_substances(p.select(cells.alias("cells"), F.col("p_partkey").alias("file_order")))


def overlay_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO2, SC10: documents that only an overlay holds, of two lanes the first."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    key = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    lanes_ = [l.filter(f"doc_id % {m} = 0").select(F.lit(f"lane{m}").alias("lane"), key.alias("key")) for m in (3, 2)]
    first = catalog.first_lane(*lanes_)
    return incremental.only_overlays(d.filter("doc_id % 7 <> 0").select(key.alias("key")), first).join(first, "key").select("key", "lane")


def hit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, RT9: the turn of a conversation that a snippet of its text is found in, whole, else the snippet."""
    c = read(spark, sf_dir, "conversations")
    hits = c.select(F.concat_ws("-", "conv_id", "turn").alias("hit"), F.col("conv_id").alias("sec"), F.when(F.col("turn") % 3 == 2, "nowhere to be found").otherwise(F.left("text", F.lit(160))).alias("snippet"))
    blocks = c.select(F.col("conv_id").alias("sec"), F.col("turn").alias("ord"), "text")
    return retrieval.display_text(hits, blocks).select("hit", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO1, DO3: each page as the panel of a crawled page; its article without the site's chrome."""
    p = read(spark, sf_dir, "pages")
    body = F.concat(F.lit('<div id="tabpanel-rcp-panel"><div id="contenu"><p class="AmmAnnexeTitre1"><a name="RcpDenomination">1.</a></p><p>'), F.coalesce("url", F.lit("")), F.lit("</p><button>x</button>"), F.coalesce("html", F.lit("")), F.lit("</div></div>"))
    return articles.articles(p.select(F.col("page_id").alias("key"), body.alias("html"))).select("key", "name", F.length("html").cast("long").alias("chars"), F.contains("html", F.lit("<script")).alias("script"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO5, DO6, FP18: pages with links to their frequent long words, contents and slugs."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "html")
    words = p.select("key", F.explode(F.array_distinct(F.split(X.same_length_fold(F.col("html")), "[^A-Z0-9]+"))).alias("term")).filter("term RLIKE '^[A-Z]{6,}$'")
    terms = words.groupBy("term").agg(F.min("key").alias("key"), F.count("*").alias("n")).filter("n >= 3").select("term", "key", F.concat_ws("-", "key", F.lower("term")).alias("slug"))
    return articles.cleaned(p, terms).select("key", "name", F.size("toc").cast("long").alias("titles"), F.array_join("slugs", ",").alias("slugs"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        central_entries, seeded_links, crawl_targets, baked_pages, vector_payloads, page_hashes, display_values, descriptions, search_rows, index_dates, stub_pages, lane_gauges, embedding_queue,
        page_states, lane_totals, substances, overlay_keys, hit_texts, page_articles, page_links,
    )
}

_AUTH = "CASE WHEN p_partkey % 2 = 0 THEN 'EU/1/00/' || p_size ELSE p_name END"
_KEY = "lpad(p_partkey::VARCHAR, 8, '0')"
_SLUG = "coalesce(nullif(lower(left(trim(regexp_replace({}, '[^a-zA-Z0-9]+', '-', 'g'), '-'), 80)), ''), 'rcp')"
_BYTE = "lpad(to_hex(CASE WHEN x < 0 THEN x + 256 ELSE x END), 2, '0')"

ORACLE_SQL: dict[str, str] = {
    "central_entries": """SELECT s_suppkey::VARCHAR AS key, s_name AS name, CASE WHEN s_suppkey % 4 = 2 THEN 'EU/1/' || lpad(s_nationkey::VARCHAR, 2, '0') || '/' || s_suppkey ELSE '' END AS eu,
      CASE WHEN s_suppkey % 4 = 2 THEN 'Holder ' || s_nationkey ELSE '' END AS holder FROM supplier WHERE s_suppkey % 4 IN (0, 2)""",
    "seeded_links": f"""WITH e AS (SELECT {_KEY} AS key, p_name, {_AUTH} AS auth, p_partkey % 31 = 0 AS linked FROM part), n AS (SELECT auth, min(key) AS key FROM e GROUP BY auth HAVING NOT bool_or(linked))
      SELECT e.key, 'https://' || split_part(e.p_name, ' ', 1) AS url FROM n JOIN e ON n.key = e.key""",
    "crawl_targets": f"WITH e AS (SELECT {_KEY} AS key, {_AUTH} AS auth, p_partkey % 97 = 1 OR p_partkey % 89 = 3 AS seeded FROM part) SELECT key FROM e WHERE auth IN (SELECT auth FROM e WHERE seeded)",
    "baked_pages": """WITH p AS (SELECT page_id, url, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS esc, page_id % 5 = 0 AS bare FROM pages),
      h AS (SELECT *, CASE WHEN bare THEN '<body><div>' || url || '</div>' ELSE '<body><div id="textDocument" data-ema-date="2024-01-02"' || CASE WHEN page_id % 2 = 0 THEN ' data-ema-fetched="2024-05-06"' ELSE '' END || ' data-ema-pdf="' || esc || '"'
        || CASE WHEN page_id % 3 = 0 THEN ' data-ema-archive="1"' ELSE '' END || '>' || url || '</div>' END AS html FROM p)
      SELECT page_id, sha256(html) AS hash, CASE WHEN bare THEN '' ELSE '2024-01-02' END AS date, CASE WHEN NOT bare AND page_id % 2 = 0 THEN '2024-05-06' ELSE '' END AS fetched, CASE WHEN bare THEN '' ELSE url END AS pdf, NOT bare AND page_id % 3 = 0 AS archived FROM h""",
    "vector_payloads": f"""WITH e AS (SELECT label AS key, vec_id, {_Q} AS q FROM embeddings), g AS (SELECT key, count(*) AS n, arg_min(vec_id, vec_id) AS v, arg_min(q, vec_id) AS q FROM e GROUP BY key)
      SELECT key, n, 'sec-' || v AS first_sec, to_base64(unhex(list_aggregate(list_transform(q, lambda x: {_BYTE}), 'string_agg', ''))) AS first_q, list_sum(q)::BIGINT AS first_sum, 'm' AS model, len(q)::INT AS dim FROM g""",
    "page_hashes": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN sha256('full' || chr(0) || coalesce(html, '') || chr(0) || coalesce(url, '')) ELSE sha256('stub' || chr(0) || coalesce(url, '')) END AS page_hash,
      left(sha256('6' || chr(0) || html), 16) AS raw_hash FROM pages""",
    "display_values": """WITH o AS (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS n, floor(o_totalprice * 2)::BIGINT AS s, o_totalprice / 400000 AS score FROM orders),
      u AS (SELECT *, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS c FROM o)
      SELECT o_orderkey, CASE WHEN n < 1 THEN 'aujourd''hui' WHEN n < 31 THEN 'il y a ' || n || ' jour' || CASE WHEN n > 1 THEN 's' ELSE '' END WHEN n < 365 THEN 'il y a ' || greatest(1, floor(n / 30 + 0.5)::BIGINT) || ' mois'
        ELSE 'il y a ' || (n // 365) || ' an' || CASE WHEN n // 365 > 1 THEN 's' ELSE '' END END AS age, n > 365 AS old, d || 'd' || h || 'h' || m || 'm' AS dhm,
        array_to_string(list_filter([CASE WHEN d > 0 THEN d || ' j' END, CASE WHEN h > 0 THEN h || ' h' END, CASE WHEN m > 0 THEN m || ' min' END, CASE WHEN c > 0 THEN c || ' s' END], lambda x: x IS NOT NULL)[1:2], ' ') AS two,
        (s // 3600) || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(c::VARCHAR, 2, '0') AS hms, floor(least(1.0, score) * 100 + 0.5)::BIGINT AS pct FROM u""",
    "descriptions": """SELECT p_partkey, 'RCP de ' || p_name || ' : indications, posologie, contre-indications, effets indésirables et interactions.' || CASE WHEN p_size > 20 THEN ' Substance active : ' || lower(p_type) || '.' ELSE '' END || ' Source ANSM / BDPM.' AS national,
      CASE WHEN p_size % 2 = 0 THEN 'RCP de ' || p_name || ', médicament autorisé au niveau européen (procédure centralisée EMA), converti depuis le PDF officiel : indications, posologie, effets indésirables. Source EMA.'
        ELSE p_name || ' : médicament à autorisation de mise sur le marché européenne centralisée (EMA). Accès au RCP officiel de l''EMA et aux génériques.' END AS central FROM part""",
    "search_rows": f"""WITH r AS (SELECT 'p' || p_partkey AS key, p_name AS name, {_SLUG.format('p_name')} AS slug, p_type AS sub, NULL::INT AS eu FROM part UNION ALL SELECT 's' || s_suppkey, s_name, {_SLUG.format('s_name')}, NULL, 1 FROM supplier),
      m AS (SELECT *, CASE WHEN key LIKE 'p%7' THEN 1 END::INT AS ret FROM r)
      SELECT key, name, eu, ret, '{{"cis":"' || key || '","name":"' || name || '","slug":"' || slug || '"' || coalesce(',"sub":"' || sub || '"', '') || coalesce(',"eu":' || eu, '') || coalesce(',"ret":' || ret, '') || '}}' AS line FROM m""",
    "index_dates": """WITH m AS (SELECT doc_id, arg_max(('2024-01-0' || quality), '2024-01-0' || quality) AS d, arg_max(toxic = 0, '2024-01-0' || quality) AS full_ FROM labels GROUP BY doc_id)
      SELECT d.doc_id AS key, source, coalesce(m.d, '') AS "asof", coalesce(full_, true) AS "full" FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""",
    "stub_pages": """SELECT s_suppkey, '<div class="rcp-stub">' || CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN '<p class="stub-meta">' || concat_ws('<br>', CASE WHEN s_suppkey % 2 = 0 THEN 'N° d''AMM européenne : <strong>EU/1/00/' || s_suppkey || '</strong>' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Titulaire : A &amp; B' END) || '</p>' ELSE '' END
      || '<p class="stub-actions"><a class="stub-ema" href="' || CASE WHEN s_suppkey % 2 = 1 THEN 'https://x/?a=1&amp;b=2' ELSE 'https://search/?q=' || replace(s_name, '#', '%23') END || '" target="_blank" rel="noopener">'
      || CASE WHEN s_suppkey % 2 = 1 THEN 'Consulter le RCP officiel (PDF) sur le site de l''EMA →' ELSE 'Consulter le RCP officiel sur le site de l''EMA →' END || '</a></p>'
      || CASE WHEN s_suppkey % 5 = 0 THEN '<p class="stub-generics">Génériques à base de <strong>Ring</strong> disponibles sur ce site : <a href="/?q=ring">voir les résultats</a>.</p>' ELSE '' END || '</div>' AS body FROM supplier""",
    "lane_gauges": """WITH r AS (SELECT user_id, max(ts) AS t, arg_max(event_type, (ts, event_id)) AS st FROM events GROUP BY user_id),
      k AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'eu' ELSE 'rcp' END AS lane, st = 'error' OR floor((epoch_us(TIMESTAMP '2024-01-08') - epoch_us(t)) / 86400000000) >= CASE WHEN user_id % 3 = 0 THEN 1 ELSE 3 END AS due FROM r),
      g AS (SELECT lane, count(*) AS total, count(*) FILTER (due) AS d, count(*) FILTER (lane = 'rcp' AND user_id % 2 <> 0) AS forced FROM k GROUP BY lane)
      SELECT lane, total, greatest(d, forced) AS due, forced, round(greatest(d, forced) * CASE WHEN lane = 'eu' THEN 305.0 ELSE 6.0 END, 1) AS eta_s FROM g""",
    "embedding_queue": """WITH f AS (SELECT user_id AS key, arg_min(CASE event_type WHEN 'purchase' THEN 'user' WHEN 'click' THEN 'crawl' ELSE 'sweep' END, event_id) AS source, min(event_id) AS "at" FROM events GROUP BY user_id),
      q AS (SELECT *, row_number() OVER (ORDER BY "at", key) AS i FROM f QUALIFY i <= 60 OR source = 'user') SELECT key, source, "at", count(*) OVER (PARTITION BY source) AS n FROM q""",
    "page_states": """SELECT DISTINCT d.doc_id AS key, CASE WHEN d.doc_id % 10 = 9 THEN 'crawling' WHEN d.doc_id NOT IN (SELECT doc_id FROM labels) THEN 'unavailable' WHEN d.doc_id IN (SELECT vec_id FROM embeddings) THEN 'fresh' ELSE 'queued' END AS status,
      d.doc_id % 4 = 0 AS pending, true AS "full" FROM documents d""",
    "lane_totals": """SELECT user_id % 2 AS lane, count(*) FILTER (event_type NOT IN ('error', 'view')) AS ok, count(*) FILTER (event_type = 'view') AS empty, count(*) FILTER (event_type = 'error') AS error,
      count(*) FILTER (user_id % 3 = 0) AS "user", count(*) FILTER (user_id % 3 = 1) AS auto, count(*) FILTER (user_id % 3 = 2) AS crawl, max(ts) AS last FROM events GROUP BY 1""",
    "substances": """SELECT p_brand AS key, string_agg(s, ' ' ORDER BY o) AS text FROM (SELECT p_brand, lower(s) AS l, arg_min(s, p_partkey) AS s, min(p_partkey) AS o FROM (SELECT p_brand, p_partkey, p_name AS s FROM part WHERE p_size % 2 = 0) GROUP BY 1, 2) GROUP BY p_brand""",
    "overlay_keys": """SELECT lpad(l.doc_id::VARCHAR, 8, '0') AS key, min(CASE WHEN l.doc_id % 3 = 0 THEN 'lane3' ELSE 'lane2' END) AS lane FROM labels l WHERE (l.doc_id % 3 = 0 OR l.doc_id % 2 = 0) AND l.doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) GROUP BY 1""",
    "hit_texts": r"""WITH c AS (SELECT conv_id, turn, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations), h AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'nowhere to be found' ELSE left(text, 160) END AS s FROM c),
      n AS (SELECT *, left(lower(trim(regexp_replace(s, '\s+', ' ', 'g'))), 40) AS n FROM h), f AS (SELECT n.conv_id, n.turn, arg_min(c.text, c.turn) AS whole FROM n JOIN c ON n.conv_id = c.conv_id AND length(n) >= 8 AND contains(c.t, n) GROUP BY 1, 2)
      SELECT n.conv_id || '-' || n.turn AS hit, sha256(coalesce(whole, s)) AS text_hash FROM n LEFT JOIN f ON n.conv_id = f.conv_id AND n.turn = f.turn""",
}
