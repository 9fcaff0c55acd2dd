"""Scans, stores and indexes over the driver's tables, with SQL twins: quoted ranges, incremental rebuilds, fuzzy words, page ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.vectors import quantize
from folio.operators import fuzzy, incremental, lanes, pdf_lines, retrieval
from folio.plans.catalog_queries import _BARE, _MARKED, _Q, Query, _literal, read
from folio.sources import catalog
from folio.sources.versions import VersionedTable
from folio.staging import hadoop, stage_path, staged
from folio.streaming import overlays


def _forget(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def quoted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6: documents written as headed files of quoted cells with line ends in them, and read back in byte ranges."""
    path = stage_path(spark, "quoted")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("Code"), F.coalesce("text", F.lit("")).alias("Text"))
    d.write.option("sep", "\t").option("quoteAll", True).option("escape", '"').option("header", True).option("emptyValue", "").csv(path)
    got = catalog.baseline(spark, path)
    out = staged(got.select(F.col("key").cast("long").alias("doc_id"), F.length("html").cast("long").alias("n_chars"), F.sha2(F.col("html").cast("binary"), 256).alias("hash")), "quoted")
    _forget(spark, path)
    return out


def incremental_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, H3, SK9: outputs of all documents, rebuilt after a change: what was there before is taken over, with its version.

    Before, documents labelled toxic were missing, those labelled of low quality had another text, and some existed that have
    gone since.
    """
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "source", "text")
    label = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic")
    before = d.join(label, "key", "left").filter("coalesce(toxic, 0) = 0").withColumn("text", F.when(F.col("quality") == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))).drop("quality", "toxic")
    gone = d.filter("lang = 'es'").withColumn("key", -F.col("key") - 1)

    def records(rows: DataFrame) -> DataFrame:
        return rows.join(incremental.hashes(rows, "lang", "source", "text"), "key")

    def render(rows: DataFrame) -> DataFrame:
        return rows.select("key", "hash", F.upper("lang").alias("lang"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("page"))

    table = VersionedTable(spark, stage_path(spark, "pages"), buckets=16)
    part = read(spark, sf_dir, "part")
    shared = incremental.global_key(F.lit("1"), F.lit("<p>"), part.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("text")), part.select(F.col("p_name").alias("term"), F.col("p_brand").alias("slug"))).first()["key"]
    incremental.rebuild(table, records(before.unionByName(gone)), render, shared)
    done = incremental.rebuild(table, records(d), render, shared)
    out = table.read(done.version).select(F.col("key").alias("doc_id"), "lang", "n_chars", "page", F.col("made_in").cast("long").alias("made_in"))
    return out.withColumns({c: F.lit(n).cast("long") for c, n in (("n_computed", done.computed), ("n_reused", done.reused), ("n_dropped", done.dropped))})


def overlay_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1, ST1, J1: labels as overlays that come as a stream of three batches, the last one repeated, over documents in which Spanish ones are missing.

    First every labelled document gets a payload, then toxic ones an empty one, then those of low quality one that is too old.
    """
    label = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), "quality", "toxic")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("ts")
    parts = [label.select("key", F.lit("first").alias("payload"), at(2)), label.filter("toxic = 1").select("key", F.lit("").alias("payload"), at(3)), label.filter("quality = 0").select("key", F.lit("old").alias("payload"), at(1))]
    base = stage_path(spark, "feed")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{base}/in/{i}")
    table = VersionedTable(spark, f"{base}/store", buckets=16)
    stream = spark.readStream.schema(overlays.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    stream.writeStream.foreachBatch(overlays.sink(table, "feed")).option("checkpointLocation", f"{base}/at").trigger(availableNow=True).start().awaitTermination()
    overlays.upsert(table, parts[2], "feed", 2)  # as after a crash between the commit and the stream's own
    docs = read(spark, sf_dir, "documents").filter("lang <> 'es'").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("html"))
    got = overlays.states(table, docs, F.lit("2022-01-01"))
    state = F.when(F.col("archived"), "archived").when(F.col("html") == "first", "overlay").otherwise("baseline")
    return got.select(F.col("key").cast("long").alias("doc_id"), state.alias("state"), "asof")


def stored_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, SO1: documents' keys with text from a written file, of which the second call reads the snapshot alone."""
    path, at = stage_path(spark, "quoted"), stage_path(spark, "presence")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("Code"), F.when(F.col("lang") == "de", " ").otherwise(F.col("text")).alias("Text"))
    d.write.option("sep", "\t").option("quoteAll", True).option("escape", '"').option("header", True).csv(path)
    table = VersionedTable(spark, at, buckets=8)
    catalog.present_in_baseline(spark, path, table)
    got = catalog.present_in_baseline(spark, path, table)
    _forget(spark, path)  # nothing reads it any more
    return got.select(F.col("key").cast("long").alias("doc_id"), F.lit(table.current().number).cast("long").alias("version"))


def lane_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16, AG12: counters of each user's stretches of events without a pause of six hours."""
    e = read(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "empty").otherwise("ok")
    source = F.when(F.col("event_type") == "purchase", "user").when(F.col("event_type") == "click", "auto").otherwise("crawl")
    got = lanes.sessions(e.select(F.col("user_id").alias("lane"), source.alias("source"), outcome.alias("outcome"), "ts"), "6 hours")
    return got.withColumns({"began": F.unix_micros("began"), "ended": F.unix_micros("ended")})


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO9, DO11, DO15, SC21: orders as paged documents; their lines in blocks, a table over one block of finished ones, suppliers as figures."""
    l, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    block, mark = F.floor(F.col("l_linenumber") / 2), F.pmod("l_suppkey", F.lit(7))
    text = F.when(mark == 0, "4.").when(mark == 1, "4.1").when(mark == 2, "ANNEXE II").when(mark == 3, "RÉSUMÉ DES CARACTÉRISTIQUES").otherwise(F.concat_ws(" & ", "l_returnflag", "l_partkey"))
    y = (100 + 50 * block).cast("double")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    box = [F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 30).alias("y1")]
    lines = l.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), block.alias("block"), place.alias("line"), *box, text.alias("text"), (mark < 4).alias("bold"))
    tables = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit(49.0).alias("x0"), F.lit(149.0).alias("y0"), F.lit(501.0).alias("x1"), F.lit(181.0).alias("y1"), F.array(F.array(F.lit("p"), F.lit("s")), F.array("o_orderpriority", "o_orderstatus")).alias("rows"))
    images = l.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), (y + 40).alias("y"), F.pmod("l_partkey", F.lit(5)).alias("xref"), F.col("l_quantity").alias("width"), F.lit(300).alias("height"), F.lit("u").alias("src")).filter("xref < 2")
    rows = pdf_lines.reading_order(lines, tables, images)
    html = F.md5(F.col("html").cast("binary")).alias("html")
    subs = F.aggregate("toc", F.lit(0).cast("long"), lambda a, x: a + F.size(x["subs"])).alias("subs")
    groups = F.when(F.col("toc").isNotNull(), F.size("toc")).cast("long").alias("groups")
    return pdf_lines.counted(rows).select("doc", *[f"n_{k}" for k in pdf_lines.KINDS], html, groups, subs)


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP17, SK4: search rows of parts, whose substance is left out where the folded name holds it: the name's first word for some, the type for others."""
    p = read(spark, sf_dir, "part").withColumn("key", F.col("p_partkey").cast("string"))
    first = F.concat(F.lit("É"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    text = F.when(F.col("p_size") % 3 == 0, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).when(F.col("p_size") % 3 == 1, first).otherwise(F.col("p_type"))
    entries = p.select("key", F.concat(F.lit("é"), "p_name").alias("name"))
    return incremental.search_index(entries, p.filter("p_size > 5").select("key", text.alias("text"))).select("key", "name", "slug", "sub")


def _least_words(text: Column) -> Column:
    """A text's first three words in alphabetical order, of five letters or more."""
    return F.slice(F.array_sort(F.filter(X.distinct_words(text), lambda w: F.length(w) >= 5)), 1, 3)


def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17, F17, RT5: words of all documents that match words of part names and types, with their credit."""
    words = read(spark, sf_dir, "documents").select(F.explode(X.distinct_words(F.col("text"))).alias("word"))
    terms = read(spark, sf_dir, "part").select(F.explode(X.distinct_words(F.concat_ws(" ", "p_name", "p_type", F.lit("thered underest ingtion")))).alias("term"))
    return fuzzy.matches(words, terms)


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, RT7, AG18, RT6: every label's vectors as a page's chunks, ranked for two sub-queries with words, in one job.

    A query is a vector whose id is divisible by 50, with the next one; words of a chunk's section and of a sub-query are
    those of the document of the same number.
    """
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", quantize(F.col("embedding")).alias("q"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    chunks = e.select(F.col("label").alias("page"), F.col("vec_id").alias("sec"), F.col("vec_id").alias("ord"), F.floor(F.col("vec_id") / 2).alias("block"), "q")
    sections = e.join(d, "vec_id").select(F.col("label").alias("page"), F.col("vec_id").alias("sec"), F.explode(X.distinct_words(F.col("text"))).alias("word"))
    subs = e.filter("vec_id % 50 IN (0, 1)").join(d, "vec_id").select((F.col("vec_id") - F.col("vec_id") % 50).alias("query"), (F.col("vec_id") % 50).alias("sub"), "q", _least_words(F.col("text")).alias("terms"))
    got = retrieval.rank_pages(chunks, subs, sections, 0.0, top=10)
    return got.select("page", "query", "ord", "block", F.round("cosine", 6).alias("cosine"), F.round("lexical", 6).alias("lexical"), F.col("rank").cast("long").alias("rank"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (quoted_ranges, incremental_rebuild, overlay_store, stored_presence, lane_sessions, paged_documents, search_lines, fuzzy_terms, ranked_pages)}

_WORDS = f"list_distinct(list_filter(regexp_split_to_array(lower(translate({{}}, '{_literal(_MARKED)}', '{_literal(_BARE)}')), '[^a-z0-9]+'), lambda x: length(x) >= 3))"
_CREDIT = """CASE WHEN word = term THEN 1.0 WHEN length(term) >= 4 AND length(word) >= 4 AND (starts_with(word, term) OR starts_with(term, word)) THEN 0.85
        WHEN abs(length(term) - length(word)) <= 2 AND levenshtein(term, word) <= CASE WHEN length(term) <= 5 THEN 1 ELSE 2 END THEN 0.7 ELSE 0.0 END"""

ORACLE_SQL: dict[str, str] = {
    "quoted_ranges": "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, sha256(coalesce(text, '')) AS hash FROM documents",
    "incremental_rebuild": """WITH d AS (SELECT d.*, coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 AS made FROM documents d LEFT JOIN labels USING (doc_id))
      SELECT doc_id, upper(lang) AS lang, length(text)::BIGINT AS n_chars, md5(text) AS page, CASE WHEN made THEN 2 ELSE 1 END::BIGINT AS made_in,
      count(*) FILTER (made) OVER ()::BIGINT AS n_computed, count(*) FILTER (NOT made) OVER ()::BIGINT AS n_reused, (SELECT count(*) FROM documents WHERE lang = 'es') AS n_dropped FROM d""",
    "overlay_store": """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'baseline' WHEN toxic = 1 THEN 'archived' ELSE 'overlay' END AS state, CASE WHEN coalesce(toxic, 1) = 1 THEN '2022-01-01' ELSE '2024-01-02' END AS "asof"
      FROM (SELECT * FROM documents WHERE lang <> 'es') d FULL JOIN labels l USING (doc_id) WHERE coalesce(toxic, 1) = 0 OR length(trim(coalesce(text, ''))) > 0""",
    "stored_presence": "SELECT doc_id, 1::BIGINT AS version FROM documents WHERE lang <> 'de' AND length(trim(text)) > 0",
    "lane_sessions": """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e)
      SELECT user_id AS lane, epoch_us(min(ts)) AS began, epoch_us(max(ts) + INTERVAL 6 HOUR) AS ended, count(*) FILTER (event_type NOT IN ('error', 'view')) AS ok, count(*) FILTER (event_type = 'view') AS empty, count(*) FILTER (event_type = 'error') AS error,
      count(*) FILTER (event_type = 'purchase') AS "user", count(*) FILTER (event_type = 'click') AS auto, count(*) FILTER (event_type NOT IN ('purchase', 'click')) AS crawl FROM s GROUP BY user_id, s""",
    "search_lines": """WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS f FROM part), s AS (SELECT p_partkey::VARCHAR AS key, 'é' || p_name AS name, CASE WHEN p_size <= 5 THEN NULL WHEN p_size % 3 = 0 THEN upper(f) WHEN p_size % 3 = 1 THEN 'É' || f ELSE p_type END AS t FROM p)
      SELECT key, name, key || '-' || trim(left(trim(regexp_replace(lower('e' || substr(name, 2)), '[^a-z0-9]+', '-', 'g'), '-'), 80), '') AS slug, CASE WHEN NOT contains(lower('e' || substr(name, 2)), lower(replace(t, 'É', 'E'))) THEN t END AS sub FROM s""",
    "paged_documents": r"""WITH l AS (SELECT l_orderkey AS doc, l_linenumber // 2 AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS line, l_suppkey % 7 AS mark, l_partkey, l_returnflag FROM lineitem),
      f AS (SELECT o_orderkey AS doc, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'),
      i AS (SELECT l_orderkey AS doc, 140 + 50 * (l_linenumber // 2) AS y, l_partkey % 5 AS xref FROM lineitem WHERE l_partkey % 5 < 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey % 5 ORDER BY l_linenumber // 2) = 1),
      u AS (SELECT doc, 100 + 50 * block AS y, 2 AS rank, block, line, CASE mark WHEN 0 THEN '4.' WHEN 1 THEN '4.1' WHEN 2 THEN 'ANNEXE II' WHEN 3 THEN 'RÉSUMÉ DES CARACTÉRISTIQUES' ELSE l_returnflag || ' & ' || l_partkey END AS text, mark, NULL AS html FROM l WHERE NOT (block = 1 AND doc IN (SELECT doc FROM f))
        UNION ALL SELECT doc, 149, 0, 0, 0, NULL, 9, '<table><tr><th>p</th><th>s</th></tr><tr><td>' || p || '</td><td>F</td></tr></table>' FROM f
        UNION ALL SELECT doc, y, 1, xref, 0, NULL, 9, '<figure><img src="u" alt=""></figure>' FROM i),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY y, rank, block, line) AS r FROM u), b AS (SELECT *, last_value(CASE WHEN rank <> 1 THEN r END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM n),
      t AS (SELECT b.*, CASE WHEN b.rank = 2 AND p.mark < 2 AND b.mark > 1 THEN p.text END AS before FROM b LEFT JOIN n p ON p.doc = b.doc AND p.r = b.pr),
      k AS (SELECT *, CASE WHEN before IS NULL THEN text ELSE before || ' ' || text END AS label, CASE WHEN rank = 0 THEN 'table' WHEN rank = 1 THEN 'figure' WHEN mark < 2 THEN 'marker' WHEN before = '4.' AND mark IN (2, 3) THEN 'group'
        WHEN before = '4.1' THEN 'heading2' WHEN before = '4.' THEN 'heading1' WHEN mark IN (2, 3) THEN 'group' ELSE 'text' END AS kind FROM t),
      g AS (SELECT *, CASE WHEN kind = 'text' AND lag(kind) OVER w = 'text' AND lag(block) OVER w = block THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc ORDER BY r)),
      h AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY r) AS part FROM g), q AS (SELECT doc, part, kind, string_agg(label, ' ' ORDER BY r) AS label, min(html) AS html FROM h WHERE kind <> 'marker' GROUP BY doc, part, kind),
      o AS (SELECT *, CASE WHEN kind = 'group' AND coalesce(lag(kind) OVER (PARTITION BY doc ORDER BY part) <> 'group', true) THEN 1 ELSE 0 END AS opens FROM q),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY part) AS grp, sum(CASE WHEN kind = 'heading1' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY part) AS sec, replace(label, '&', '&amp;') AS e FROM o),
      x AS (SELECT doc, grp, string_agg(label, ' - ' ORDER BY part) FILTER (kind = 'group') AS title, count(*) FILTER (kind = 'heading1') AS heads, count(*) FILTER (kind <> 'group') AS parts, string_agg(coalesce(html, CASE kind WHEN 'heading1' THEN '<h2 class="AmmAnnexeTitre1" id="sec-' || sec || '">' || e || '</h2>'
        WHEN 'heading2' THEN '<h3 class="AmmAnnexeTitre2">' || e || '</h3>' ELSE '<p>' || e || '</p>' END), '' ORDER BY part) FILTER (kind <> 'group') AS inner_ FROM s GROUP BY doc, grp),
      y AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY grp) AS gn, coalesce(title, 'Document') AS name, contains(coalesce(title, ''), 'RÉSUMÉ') AS op FROM x WHERE parts > 0),
      z AS (SELECT doc, md5('<div id="textDocument">' || string_agg('<details class="ema-annexe"' || CASE WHEN op THEN ' open' ELSE '' END || '><summary id="grp-' || gn || '">' || replace(name, '&', '&amp;') || '</summary>' || inner_ || '</details>', '' ORDER BY grp) || '</div>') AS html,
        count(*) AS groups, sum(CASE WHEN op THEN heads ELSE 0 END)::BIGINT AS subs FROM y GROUP BY doc)
      SELECT doc, count(*) FILTER (kind = 'group') AS n_group, count(*) FILTER (kind = 'heading1') AS n_heading1, count(*) FILTER (kind = 'heading2') AS n_heading2, count(*) FILTER (kind = 'text') AS n_text, count(*) FILTER (kind = 'table') AS n_table,
      count(*) FILTER (kind = 'figure') AS n_figure, any_value(z.html) AS html, any_value(groups) AS groups, any_value(subs) AS subs FROM s LEFT JOIN z USING (doc) GROUP BY doc""",
    "fuzzy_terms": f"""WITH w AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS word FROM documents), t AS (SELECT DISTINCT unnest({_WORDS.format("p_name || ' ' || p_type || ' thered underest ingtion'")}) AS term FROM part)
      SELECT term, word, credit FROM (SELECT term, word, CAST({_CREDIT} AS DOUBLE) AS credit FROM w, t) WHERE credit > 0""",
    "ranked_pages": f"""WITH e AS (SELECT vec_id, label, list_transform({_Q}, lambda x: x / 127) AS q FROM embeddings), d AS (SELECT doc_id AS vec_id, {_WORDS.format('text')} AS ws FROM documents),
      s AS (SELECT vec_id - vec_id % 50 AS query, vec_id AS sub, q, list_sort(list_filter(ws, lambda x: length(x) >= 5))[1:3] AS ts FROM e JOIN d USING (vec_id) WHERE vec_id % 50 IN (0, 1)),
      t AS (SELECT query, sub, unnest(ts) AS term FROM s), w AS (SELECT vec_id, unnest(ws) AS word FROM e JOIN d USING (vec_id)),
      c AS (SELECT * FROM (SELECT term, word, CAST({_CREDIT} AS DOUBLE) AS credit FROM (SELECT DISTINCT term FROM t), (SELECT DISTINCT word FROM w)) WHERE credit > 0),
      b AS (SELECT vec_id, term, max(credit) AS credit FROM w JOIN c USING (word) GROUP BY ALL), n AS (SELECT sub, count(*) AS n FROM t GROUP BY sub),
      l AS (SELECT vec_id, query, sum(credit / n) / (SELECT count(*) FROM s WHERE s.query = t.query) AS lexical FROM b JOIN t USING (term) JOIN n USING (sub) GROUP BY vec_id, query),
      p AS (SELECT label AS page, query, e.vec_id AS ord, e.vec_id // 2 AS block, round(avg(list_dot_product(e.q, s.q)), 8) AS cosine FROM e, s GROUP BY ALL HAVING cosine >= 0.0),
      r AS (SELECT p.*, coalesce(lexical, 0) AS lexical, round(cosine + 0.15 * coalesce(lexical, 0), 8) AS score FROM p LEFT JOIN l ON l.vec_id = p.ord AND l.query = p.query QUALIFY row_number() OVER (PARTITION BY page, p.query, block ORDER BY score DESC, ord) = 1)
      SELECT page, query, ord, block, round(cosine, 6) AS cosine, round(lexical, 6) AS lexical, row_number() OVER (PARTITION BY page, query ORDER BY score DESC, ord) AS rank FROM r QUALIFY rank <= 10""",
}
