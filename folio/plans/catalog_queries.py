"""The reference's operators over the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.vectors import dequantize, dot, quantize, truncate_and_normalize
from folio.functions.word_lists import LINK_STOP
from folio.operators import entities, freshness, fuzzy, html_blocks, incremental, retrieval
from folio.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("sub"))


def instant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK3, FP16: the first 40 matches in key order, then ranked."""
    return retrieval.instant_search(_parts_index(spark, sf_dir), "a").select("key", "name", F.col("rank").cast("long").alias("rank"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3, F5, F9, F15 on part names."""
    p, n = read(spark, sf_dir, "part"), F.col("p_name")
    return p.select("p_partkey", X.slug(n).alias("slug"), X.sort_key(n).alias("sort_key"), X.browse_letter(n).alias("letter"), X.collapse(n).alias("collapsed"), X.html_escape(n).alias("escaped"))


def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, AG1: in how many documents each token occurs, accents folded."""
    return read(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))


def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: hashes of records, parted by NUL."""
    return incremental.hashes(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key"), "lang", "source", "text")


def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against an earlier state in which those of nation 3 were missing and negative balances differed."""
    c = read(spark, sf_dir, "customer")
    now = c.filter("c_nationkey <> 5").select(F.col("c_custkey").alias("key"), F.sha2(F.concat_ws("|", "c_name", "c_mktsegment").cast("binary"), 256).alias("hash"))
    old = c.filter("c_nationkey <> 3").select(F.col("c_custkey").alias("key"), F.sha2(F.concat_ws("|", F.when(F.col("c_acctbal") < 0, F.lit("?")).otherwise(F.col("c_name")), "c_mktsegment").cast("binary"), 256).alias("hash"))
    return incremental.plan(now, old)


def first_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; the texts themselves are not shuffled."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("body"))
    return d.groupBy("body").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11, TK8."""
    return incremental.letter_counts(read(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


def best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: arg-max with a composite key and the earliest row among equals."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct((F.col("o_orderstatus") == "F").alias("a"), "o_totalprice", (-F.col("o_orderkey")).alias("b"))).alias("o_orderkey"))


def percentile_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4, AG5: best order of each customer, else the exact first quartile of all."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    best = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    p25 = entities.fallback_score(o.select(F.col("o_totalprice").alias("score")))
    return c.join(best, c["c_custkey"] == best["o_custkey"], "left").crossJoin(F.broadcast(p25)).select("c_custkey", F.round(F.coalesce("best", "fallback"), 4).alias("score"), F.col("best").isNotNull().alias("matched"))


def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, J5, AG5: part names against terms of one or two words (part types), by token containment."""
    p = read(spark, sf_dir, "part")
    entries = entities.signals(p.select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name")))
    terms = p.groupBy(F.col("p_type").alias("term")).agg(F.max("p_size").cast("double").alias("score")).unionByName(p.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("term")).agg((F.avg("p_size") + 50).alias("score")))
    return entities.score(entries, terms).select("key", F.round("score", 4).alias("score"), "matched")


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO5, W6, J7: the first 15 linked terms of each document, each once, none to itself; terms are its frequent long words."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    words = d.select("key", F.explode(X.linkable_words(F.col("text"))).alias("term")).filter("term RLIKE '^[A-Z]{6,}$'")
    terms = words.groupBy("term").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n >= 5")
    return entities.links_in_text(d, terms).select("key", F.col("ord").cast("long").alias("ord"), "term", "target")


def overlay_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2, SO1, SC13: documents under labels as overlays (toxic as the empty one), three states, and what is present."""
    base = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("html"))
    over = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, "").otherwise("overlay").alias("html"))
    state = F.when(F.col("archived"), "archived").when(F.col("html") == "overlay", "overlay").otherwise("baseline")
    got = catalog.merged(base, over, base_date=F.lit("2020-01-01")).select("key", state.alias("state"), "asof")
    there = catalog.present(base, over).withColumn("present", F.lit(True))
    return got.join(there, "key", "left").select(F.col("key").alias("doc_id"), "state", "asof", F.coalesce("present", F.lit(False)).alias("present"))


def borrowed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders borrow the customer's latest finished one."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("auth"), F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("has"), "o_orderdate")
    return entities.borrow(o, F.struct("o_orderdate", "key"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, SO2: customers without a large finished order."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 300000")
    only = incremental.only_overlays(o.select(F.col("o_custkey").alias("key")), c.select(F.col("c_custkey").alias("key")))
    return c.join(only, c["c_custkey"] == only["key"]).select("c_custkey", "c_name")


def best_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2, AG7, FP2, J6: for each word of six letters that parts are named or typed by, the best part with a page."""
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string").alias("key")
    entries = p.select(key, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", x")).alias("name"), F.col("p_partkey").alias("file_order"))
    comp = p.select(key, (F.col("p_size") % 3).cast("long").alias("n_links"), X.tokens(F.col("p_type")).alias("tokens"))
    words = p.select(F.explode(X.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("term"))
    return entities.link_terms(entries, comp, p.select(key, F.col("p_retailprice").alias("score")), words, p.filter("p_partkey % 2 = 0").select(key), p.select(key, F.col("p_name").alias("name")))


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12."""
    return freshness.outcome_counts(read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("source"), F.col("event_type").alias("outcome")))


def word_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types against brands and types by whole words, equal ones first."""
    p = read(spark, sf_dir, "part")
    names = p.select(F.col("p_type").alias("name")).distinct()
    heads = p.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("name")).agg(F.min("p_partkey").alias("ord")).unionByName(p.groupBy(F.col("p_type").alias("name")).agg((F.min("p_partkey") + 1_000_000_000).alias("ord")))
    heads = heads.groupBy("name").agg(F.min("ord").alias("ord"))
    return entities.word_prefix_join(names, heads)


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 to M3: codes of 64 components, their sum, and how far the decoded vector is from the first one's direction."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", quantize(F.col("embedding")).alias("q"))
    return e.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.array_max(F.transform("q", lambda x: F.abs(x.cast("int")))).cast("long").alias("code_max"), F.round(dot(dequantize(F.col("q")), dequantize(F.col("q"))), 6).alias("norm2"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, TK5: the 25 nearest of all vectors to each vector whose id is divisible by 50, from a cosine of 0.05 on."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), quantize(F.col("embedding")).alias("q"))
    return retrieval.nearest(e, e.filter("key % 50 = 0").withColumnRenamed("key", "query"), 0.05).select("query", "key", "cosine", F.col("rank").cast("long").alias("rank"))


def ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT7, RT8, AG18, FP12: vectors as one page's chunks, two a block, ranked by their mean cosine to 25 sub-queries."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", quantize(F.col("embedding")).alias("q"))
    none = F.array().cast("array<string>")
    chunks = e.select(F.col("vec_id").alias("ord"), F.floor(F.col("vec_id") / 2).alias("block"), "q", none.alias("words"))
    got = retrieval.rank_passages(chunks, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("ord"), "q", none.alias("terms")), -0.2)
    return got.select("ord", "block", F.round("cosine", 8).alias("cosine"))


def truncated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the first 16 components, normalised."""
    v = truncate_and_normalize(F.col("embedding"), 16)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.array_max(v), 6).alias("largest"))


def word_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F17, RT5, RT6: lexical score of three terms on each document's distinct words, accents folded."""
    d = read(spark, sf_dir, "documents")
    terms = spark.createDataFrame([(0, t) for t in ("tion", "thered", "under")], "query int, term string")
    got = fuzzy.lexical_scores(d.select(F.col("doc_id").alias("key"), F.explode(X.distinct_words(F.col("text"))).alias("word")), terms)
    return d.select("doc_id").join(got.select(F.col("key").alias("doc_id"), "lexical"), "doc_id", "left").select("doc_id", F.round(F.coalesce("lexical", F.lit(0.0)), 6).alias("lexical"))


def due_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP6: users whose last view is two whole days ago or more, or whose last event is an error."""
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max("t").alias("last"), F.max_by("event_type", F.struct("t", "event_id")).alias("kind"))
    end = e.agg(F.max("t").alias("now"))
    due = freshness.is_due(F.col("last"), F.col("kind"), F.col("now"), 2)
    return last.crossJoin(F.broadcast(end)).select("user_id", due.alias("due"), freshness.too_soon(F.col("last"), F.col("now"), 3600).alias("too_soon"))


def rolling_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within the hour up to each."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return freshness.rolling_count(e).select("event_id", "n_hour")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, AG15: counts by type and share of errors, with rates guarded against nothing."""
    e = read(spark, sf_dir, "events")
    p = freshness.progress(F.count("*").cast("double"), F.lit(1_000_000.0), F.count_if(F.col("event_type") == "view").cast("double"))
    got = e.groupBy(F.pmod("user_id", F.lit(10)).alias("lane")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), p.alias("p"))
    return got.select(F.col("lane").cast("long").alias("lane"), "n", "errors", F.round("p.pct", 6).alias("pct"), F.round("p.per_minute", 6).alias("per_minute"), F.round("p.eta_s", 4).alias("eta_s"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16, SC17: a number out of JSON text; invalid text has none."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, SK6: addresses without query, fragment and final slash, and their depth."""
    u = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "")
    return read(spark, sf_dir, "pages").select("page_id", u.alias("loc"), (F.size(F.split(u, "/")) - 3).cast("long").alias("depth"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO2, DO4: blocks of each page by kind; decoration, scripts and navigation are gone."""
    b = html_blocks.blocks(read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "html"))
    return b.groupBy("key").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "text").alias("texts"), F.sum(F.length("text")).alias("chars"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO8: retrieval chunks of each page."""
    return html_blocks.chunks(read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "html"))


def shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, AG8: the longest token that a supplier's name shares with customers' segments, names or nations."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    left = s.select(F.col("s_suppkey").alias("key"), X.tokens(F.concat_ws(" ", "s_name", "n_name")).alias("tokens"))
    pages = read(spark, sf_dir, "nation").select(X.tokens(F.col("n_name")).alias("tokens"))
    return entities.longest_shared_token(left, pages)


def ordered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: each brand's distinct types, in the order of their first part."""
    p = read(spark, sf_dir, "part")
    return entities.ordered_distinct_text(p, "p_brand", F.col("p_type"), "p_partkey", ";")


def title_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation whose role differs from the one before."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), F.col("role").alias("sec"))
    return retrieval.grouped_titles(c, "conv_id").select("conv_id", F.col("rank").alias("turn"), F.col("show_title").alias("changes"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        instant_search, text_scalars, token_frequency, record_hashes, incremental_plan, first_of_copies, letter_counts, best_order, percentile_fallback, term_scores, document_links, overlay_states,
        borrowed_orders, customers_without_orders, word_prefixes, vector_codes, nearest_vectors, truncated_vectors, word_credit, due_users, rolling_requests, outcomes, json_props, canonical_urls, page_blocks,
        page_chunks, shared_tokens, ordered_types, title_changes, best_terms, outcome_counts, ranked_passages,
    )
}

_SLUG = "trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '-', 'g'), '-')"
_TOK = "list_distinct(list_filter(regexp_split_to_array(upper({}), '[^A-Z0-9]+'), lambda w: w <> ''))"
_UP, _LOW = "abcdefghijklmnopqrstuvwxyz" + "".join(g + g.upper() for g, _ in X.ACCENT_GROUPS), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(b * 2 * len(g) for g, b in X.ACCENT_GROUPS)
_Q = "list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::DOUBLE * 127, 0)))::INT)"

def _literal(text: str) -> str:
    return text.replace("'", "''")


_FOLD, _TO, _SEVERAL = X._fold_tables()
_MARKED, _BARE = X._mark_tables()
_ASCII = f"regexp_replace(translate(upper(replace(text, 'ß', 'ss')), '{_literal(_FOLD)}', '{_literal(_TO)}'), '[^\\x00-\\x7F]', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in sorted(LINK_STOP))

ORACLE_SQL: dict[str, str] = {
    "instant_search": """SELECT key, name, row_number() OVER (ORDER BY CASE WHEN contains(lower(name), 'a') THEN 0 ELSE 1 END, CASE WHEN starts_with(lower(name), 'a') THEN 0 ELSE 1 END, length(name), key) AS rank
      FROM (SELECT p_partkey AS key, p_name AS name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') ORDER BY p_partkey LIMIT 40) QUALIFY rank <= 15""",
    "text_scalars": f"""SELECT p_partkey, coalesce(nullif(lower(left({_SLUG}, 80)), ''), 'rcp') AS slug, lower(p_name) AS sort_key, coalesce(nullif(upper(regexp_extract(p_name, '[A-Za-z]')), ''), '#') AS letter,
      trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS collapsed, replace(replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM part""",
    "token_frequency": f"SELECT token, count(*) AS n_docs FROM (SELECT unnest({_TOK.format(_ASCII)}) AS token FROM documents) GROUP BY token",
    "record_hashes": "SELECT doc_id AS key, sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')) AS hash FROM documents",
    "incremental_plan": """WITH c AS (SELECT c_custkey AS key, sha256(c_name || '|' || c_mktsegment) AS h FROM customer WHERE c_nationkey <> 5),
      p AS (SELECT c_custkey AS key, sha256(CASE WHEN c_acctbal < 0 THEN '?' ELSE c_name END || '|' || c_mktsegment) AS o FROM customer WHERE c_nationkey <> 3)
      SELECT key, CASE WHEN h IS NULL THEN 'gone' WHEN o IS NULL THEN 'new' WHEN h = o THEN 'hit' ELSE 'changed' END AS state FROM c FULL JOIN p USING (key)""",
    "first_of_copies": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "letter_counts": "SELECT letter, count(*) AS n, CASE WHEN letter = '#' THEN 27 ELSE ascii(letter) - 64 END::INT AS ord FROM (SELECT coalesce(nullif(upper(regexp_extract(p_name, '[A-Za-z]')), ''), '#') AS letter FROM part) GROUP BY letter",
    "best_order": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) = 1",
    "percentile_fallback": """SELECT c_custkey, round(coalesce(best, (SELECT quantile_cont(o_totalprice, 0.25) FROM orders)), 4) AS score, best IS NOT NULL AS matched
      FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "term_scores": f"""WITH t AS (SELECT p_type AS term, max(p_size)::DOUBLE AS score FROM part GROUP BY 1 UNION ALL SELECT p_brand || ' ' || p_type, avg(p_size) + 50 FROM part GROUP BY 1),
      k AS (SELECT {_TOK.format('term')} AS tt, score FROM t), e AS (SELECT p_partkey AS key, {_TOK.format("p_name || ' ' || p_type || ' ' || p_brand")} AS toks FROM part),
      b AS (SELECT key, max(score) AS best FROM e JOIN k ON list_has_all(toks, tt) GROUP BY key)
      SELECT key, round(coalesce(best, (SELECT quantile_cont(score, 0.25) FROM t)), 4) AS score, best IS NOT NULL AS matched FROM e LEFT JOIN b USING (key)""",
    "document_links": f"""WITH w AS (SELECT doc_id AS key, unnest(s) AS term, unnest(range(len(s))) AS ord FROM (SELECT doc_id, regexp_split_to_array(translate(text, '{_UP}', '{_LOW}'), '[^A-Z0-9]+') AS s FROM documents)),
      f AS (SELECT key, term, min(ord) AS ord FROM w WHERE term <> '' GROUP BY ALL), t AS (SELECT term, min(key) AS target FROM f WHERE regexp_full_match(term, '[A-Z]{{6,}}') GROUP BY term HAVING count(*) >= 5)
      SELECT key, row_number() OVER (PARTITION BY key ORDER BY ord) AS ord, term, target FROM (SELECT key, ord, term, target FROM f JOIN t USING (term) WHERE key <> target) r QUALIFY row_number() OVER (PARTITION BY key ORDER BY r.ord) <= 15""",
    "overlay_states": """WITH b AS (SELECT doc_id, toxic, length(trim(coalesce(text, ''))) > 0 AS has FROM documents FULL JOIN labels USING (doc_id))
      SELECT doc_id, CASE toxic WHEN 1 THEN 'archived' WHEN 0 THEN 'overlay' ELSE 'baseline' END AS state, CASE WHEN coalesce(toxic, 1) = 1 THEN '2020-01-01' END AS "asof", coalesce(toxic, 0) = 0 AS present
      FROM b WHERE toxic = 0 OR coalesce(has, false)""",
    "best_terms": f"""WITH p AS (SELECT *, upper(split_part(p_name, ' ', 2)) AS w, p_size % 3 AS n FROM part), c AS (SELECT w AS term, p_partkey, p_retailprice, n <= 1 AS mono, p_name FROM p WHERE regexp_full_match(w, '[A-Z]+')
        UNION ALL SELECT unnest({_TOK.format('p_type')}), p_partkey, p_retailprice, true, p_name FROM p WHERE n = 1)
      SELECT term, p_partkey::VARCHAR AS key, p_partkey || '-' || {_SLUG.replace('p_name', 'lower(p_name)')} AS slug, p_name AS name FROM c
      WHERE length(term) >= 6 AND regexp_full_match(term, '[A-Z]+') AND term NOT IN ({_STOP}) AND p_partkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY mono DESC, p_retailprice DESC, p_partkey) = 1""",
    "outcome_counts": "SELECT user_id % 7 AS source, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2",
    "borrowed_orders": """WITH d AS (SELECT o_custkey, o_orderkey AS donor FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
      SELECT o_orderkey AS key, donor FROM orders JOIN d USING (o_custkey) WHERE o_orderstatus <> 'F'""",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)",
    "word_prefixes": """WITH h AS (SELECT name, min(ord) AS ord FROM (SELECT split_part(p_type, ' ', 1) AS name, min(p_partkey) AS ord FROM part GROUP BY 1 UNION ALL SELECT p_type, min(p_partkey) + 1000000000 FROM part GROUP BY 1) GROUP BY name),
      n AS (SELECT DISTINCT p_type AS l FROM part) SELECT l, name AS r FROM n JOIN h ON l = name OR starts_with(l, name || ' ') OR starts_with(name, l || ' ') QUALIFY row_number() OVER (PARTITION BY l ORDER BY l <> name, ord) = 1""",
    "vector_codes": f"SELECT vec_id, list_sum(q)::BIGINT AS code_sum, list_max(list_transform(q, lambda x: abs(x)))::BIGINT AS code_max, round(list_sum(list_transform(q, lambda x: (x / 127) * (x / 127))), 6) AS norm2 FROM (SELECT vec_id, {_Q} AS q FROM embeddings)",
    "nearest_vectors": f"""WITH e AS (SELECT vec_id, list_transform({_Q}, lambda x: x / 127) AS q FROM embeddings)
      SELECT b.vec_id AS query, a.vec_id AS key, round(list_dot_product(a.q, b.q), 8) AS cosine, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_dot_product(a.q, b.q), 8) DESC, a.vec_id) AS rank
      FROM e a, e b WHERE b.vec_id % 50 = 0 AND round(list_dot_product(a.q, b.q), 8) >= 0.05 QUALIFY rank <= 25""",
    "ranked_passages": f"""WITH e AS (SELECT vec_id, list_transform({_Q}, lambda x: x / 127) AS q FROM embeddings), b AS (SELECT * FROM e WHERE vec_id % 50 = 0 ORDER BY vec_id LIMIT 25),
      s AS (SELECT a.vec_id AS ord, a.vec_id // 2 AS block, avg(list_dot_product(a.q, b.q)) AS cosine FROM e a, b GROUP BY 1, 2 HAVING cosine >= -0.2), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY cosine DESC, ord) = 1)
      SELECT ord, block, round(cosine, 8) AS cosine FROM t ORDER BY t.cosine DESC, ord LIMIT 25""",
    "truncated_vectors": """SELECT vec_id, round(v[1] / n, 6) AS first, round(list_max(v) / n, 6) AS largest FROM (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n
      FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings))""",
    "word_credit": f"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(translate(text, '{_literal(_MARKED)}', '{_literal(_BARE)}')), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS w FROM documents),
      t(t) AS (VALUES ('tion'), ('thered'), ('under')), c AS (SELECT doc_id, t, max(CASE WHEN w = t THEN 1.0 WHEN length(t) >= 4 AND length(w) >= 4 AND (starts_with(w, t) OR starts_with(t, w)) THEN 0.85
        WHEN levenshtein(t, w) <= (CASE WHEN length(t) <= 5 THEN 1 ELSE 2 END) THEN 0.7 ELSE 0.0 END)::DOUBLE AS c FROM w, t GROUP BY doc_id, t)
      SELECT doc_id, round(coalesce(sum(c), 0) / 3, 6) AS lexical FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""",
    "due_users": """WITH l AS (SELECT user_id, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
      SELECT user_id, kind = 'error' OR floor((epoch_us(now) - epoch_us(last)) / 86400000000) >= 2 AS due, (epoch_us(now) - epoch_us(last)) / 1e6 < 3600 AS too_soon FROM l, n""",
    "rolling_requests": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_hour FROM events",
    "outcomes": """SELECT (user_id % 10)::BIGINT AS lane, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(100.0 * count(*)::DOUBLE / 1000000.0, 6) AS pct,
      round(60.0 * (count(*)::DOUBLE / nullif(count(*) FILTER (event_type = 'view'), 0)::DOUBLE), 6) AS per_minute,
      round((1000000.0::DOUBLE - count(*)) / nullif(count(*)::DOUBLE / nullif(count(*) FILTER (event_type = 'view'), 0)::DOUBLE, 0), 4) AS eta_s FROM events GROUP BY 1""",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "canonical_urls": "SELECT page_id, loc, (len(string_split(loc, '/')) - 3)::BIGINT AS depth FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS loc FROM pages)",
    "shared_tokens": f"""WITH l AS (SELECT s_suppkey AS key, unnest({_TOK.format("s_name || ' ' || n_name")}) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey), p AS (SELECT DISTINCT unnest({_TOK.format('n_name')}) AS t FROM nation)
      SELECT key, t AS token FROM l WHERE t IN (SELECT t FROM p) QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(t) DESC, t DESC) = 1""",
    "ordered_types": """SELECT p_brand, string_agg(s, ';' ORDER BY o) AS text FROM (SELECT p_brand, lower(p_type) AS l, arg_min(p_type, p_partkey) AS s, min(p_partkey) AS o FROM part GROUP BY 1, 2) GROUP BY p_brand""",
    "title_changes": "SELECT conv_id, turn, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS changes FROM conversations",
}
