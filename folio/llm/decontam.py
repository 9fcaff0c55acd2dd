"""Operator 9: benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each row holds a document's words in order, so that the posting of a term
is (row, position) and a posting of another term at a given offset is a lookup in the same row. Nothing of it
is shuffled. Test windows are looked up from their rarest term: its postings are intersected with those of the
second rarest, shifted by their offset within the window, and what is left is compared word by word. Proximity
matches look for all of a window's terms around the same postings of its rarest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize, small_enough, words_of

#: Windows that are broadcast at most, and the bytes of their terms (a term has no greatest length); beyond it the postings are shuffled by their term.
BROADCAST_WINDOWS, BROADCAST_BYTES = 100_000, 32 << 20
#: How far from its rarest term the other terms of a window may stand, in words, to count as near.
SLOP = 20


def _broadcastable(df: DataFrame, text: Column) -> bool:
    """Whether df is small in rows and in the bytes of its texts."""
    if not small_enough(df, BROADCAST_WINDOWS):
        return False
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] <= BROADCAST_BYTES


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, words): the positions of each document's words, written once.

    A null or empty text has no words. Repeated rows stay; ``text_key`` tells apart rows that share an id.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    return materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(c).alias("text_key"), words_of(c).alias("words")).withColumn("n_words", F.size("words").cast("long")),
        "positions",
    )


def windows(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, win): every ``size`` consecutive words of an item, or all of a shorter one; once each."""
    w = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    at = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))).alias("i"))
    return at.select("item_id", F.slice("w", F.col("i"), size).alias("win")).distinct()


def rarest_terms(index: DataFrame, wins: DataFrame) -> DataFrame:
    """(win, n, t1, o1, t2, o2): each distinct window with its two rarest terms and their offsets.

    The counts are those of the whole index. A window with a term that occurs nowhere cannot match and is left out.
    """
    each = wins.select("win").distinct().select("win", F.posexplode("win").alias("o", "term"))
    terms = each.select("term").distinct()
    few = _broadcastable(terms, F.col("term"))
    counts = index.select(F.explode("words").alias("term")).join(F.broadcast(terms) if few else terms, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    if few:  # no more than the terms, so that a word of many windows need not gather them in one task
        counts = F.broadcast(counts)
    ranked = each.join(counts, "term", "left").groupBy("win").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n_term", F.lit(0)).alias("n_term"), "o", "term"))).alias("r"))
    r2 = F.get("r", F.least(F.lit(1), F.size("r") - 1))
    return ranked.filter(F.col("r")[0]["n_term"] > 0).select("win", F.size("win").alias("n"), F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["o"].alias("o1"), r2["term"].alias("t2"), r2["o"].alias("o2"))


def exact_matches(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, n, win): every occurrence of a seed window in a document, 0-based."""
    if _broadcastable(seeds, F.array_join("win", " ")):
        postings = index.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "term"))
        start = F.col("pos") - F.col("o1")
        hit = (F.col("term") == F.col("t1")) & (start >= 0) & (F.get("words", start + F.col("o2")) == F.col("t2"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("win")
        return postings.join(F.broadcast(seeds), hit & same).select("doc_id", "text_key", start.alias("start"), "n", "win")
    # many windows: the rarest terms' postings meet them by shuffle, then the second rarest's, then the words
    postings = index.select("doc_id", "text_key", F.posexplode("words").alias("pos", "term"))
    first = postings.join(seeds, F.col("term") == F.col("t1")).select("doc_id", "text_key", (F.col("pos") - F.col("o1")).alias("start"), "win", "n", F.col("t2").alias("term"), (F.col("pos") - F.col("o1") + F.col("o2")).alias("pos")).filter("start >= 0")
    both = first.join(postings, (first["doc_id"].eqNullSafe(postings["doc_id"])) & (first["text_key"] == postings["text_key"]) & (first["term"] == postings["term"]) & (first["pos"] == postings["pos"])).select(first["doc_id"], first["text_key"], "start", "n", "win").distinct()
    return both.join(index, (both["doc_id"].eqNullSafe(index["doc_id"])) & (both["text_key"] == index["text_key"])).filter(F.slice("words", F.col("start") + 1, F.col("n")) == F.col("win")).select(both["doc_id"], both["text_key"], "start", "n", "win")


def near_matches(index: DataFrame, seeds: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, text_key, win): seed windows whose every term stands within ``slop`` words of an occurrence of the rarest, in any order; once each."""
    pos, low = F.col("pos"), F.greatest(F.col("pos") - slop, F.lit(0))
    around = F.slice("words", low + 1, pos + slop + 1 - low)
    near = F.array_contains(around, F.col("t2")) & (F.size(F.array_except("win", around)) == 0)
    if _broadcastable(seeds, F.array_join("win", " ")):
        postings = index.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "term"))
        return postings.join(F.broadcast(seeds), (F.col("term") == F.col("t1")) & near).select("doc_id", "text_key", "win").distinct()
    # many windows: only the words around postings of rarest terms are shuffled
    rare = index.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "term")).join(seeds.select(F.col("t1").alias("term")).distinct(), "term", "left_semi")
    local = rare.select("doc_id", "text_key", "term", around.alias("words")).distinct()
    fits = (F.col("term") == F.col("t1")) & F.array_contains("words", F.col("t2")) & (F.size(F.array_except("win", "words")) == 0)
    return local.join(seeds, fits).select("doc_id", "text_key", "win").distinct()


def proximity_matches(index: DataFrame, items: DataFrame, size: int = 10, slop: int = SLOP) -> DataFrame:
    """(doc_id, text_key, item_id, n_near): how many windows of an item have all terms near each other in a document.

    Exact occurrences count as well. Null and empty texts have no words and no matches; an empty benchmark gives no rows;
    rows that are repeated are one, as they have one id and one text.
    """
    wins = windows(items, size)
    found = near_matches(index, rarest_terms(index, wins), slop)
    return found.join(wins, "win").groupBy("doc_id", "text_key", "item_id").agg(F.countDistinct("win").alias("n_near"))


def covered(spans: Column) -> Column:
    """How many positions an array of (start, n) structs covers, overlaps once."""
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    add = lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["n"]).alias("end"), (a["total"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("total"))
    return F.aggregate(F.sort_array(spans), empty, add, lambda a: a["total"].cast("long"))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10, near: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated.

    A word is hit if it lies in any occurrence of any window of any item. Null or empty texts have no words and
    are never hit; items without words match nothing; rows that are repeated are each reported; with an empty
    benchmark nothing is hit. Further columns of either table play no part. With ``near`` there are n_near_items and
    n_near_windows besides: items, and distinct windows, whose terms all stand near their rarest one (:func:`near_matches`).
    """
    index = build_index(docs)
    wins = materialize(windows(items, size), "windows")
    seeds = materialize(rarest_terms(index, wins), "seeds")
    found = exact_matches(index, seeds).select("doc_id", "text_key", "start", "n", "win").distinct()
    found = materialize(found, "occurrences")
    spans = found.select("doc_id", "text_key", "start", "n").distinct().groupBy("doc_id", "text_key").agg(covered(F.collect_list(F.struct("start", "n"))).alias("n_hit"))
    names = found.select("doc_id", "text_key", "win").distinct().join(wins, "win").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = spans.join(names, (spans["doc_id"].eqNullSafe(names["doc_id"])) & (spans["text_key"] == names["text_key"])).select(spans["doc_id"].alias("h_id"), spans["text_key"].alias("h_key"), "n_hit", "items")
    base = index.select("doc_id", "text_key", "n_words")
    out = base.join(hits, (F.col("doc_id").eqNullSafe(F.col("h_id"))) & (F.col("text_key") == F.col("h_key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), "text_key"
    )
    if not near:
        return out
    close = materialize(near_matches(index, seeds), "near").join(wins, "win").groupBy(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"))
    counts = close.agg(F.count_distinct("item_id").alias("n_near_items"), F.count_distinct("win").alias("n_near_windows"))
    return out.join(counts, (F.col("doc_id").eqNullSafe(F.col("h_id"))) & (F.col("text_key") == F.col("h_key")), "left").drop("h_id", "h_key").na.fill(0, ["n_near_items", "n_near_windows"])


#: Contaminated documents whose ids are broadcast at most; more of them meet the documents by shuffle.
BROADCAST_FOUND = 300_000


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that :func:`contaminated` finds clean; all columns stay, whatever their names.

    Rows without words are clean; repeated rows go or stay together; an empty benchmark leaves all rows.
    """
    found = contaminated(docs, items, size).filter("contaminated").select(F.col("doc_id").alias("_folio_id"), F.col("text_key").alias("_folio_key")).distinct()
    found = materialize(found, "contaminated")
    near = F.broadcast(found) if small_enough(found, BROADCAST_FOUND) else found
    return docs.join(near, docs["doc_id"].eqNullSafe(F.col("_folio_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_folio_key")), "left_anti")


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The digest columns of :func:`contaminated`, and its proximity matches."""
    return contaminated(docs, items, size, near=True).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near_items", "n_near_windows")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS v
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), hit AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, s.n, list_slice(w, i, i + s.n - 1) AS v FROM pos, (SELECT DISTINCT n FROM win) s WHERE i + s.n - 1 <= len(w)) p
  JOIN win USING (n, v)
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), freq AS (
  SELECT w[i] AS term, count(*) AS c FROM pos GROUP BY 1
), seed AS (
  SELECT v, arg_min(t, (coalesce(c, 0), o)) AS t1 FROM (SELECT v, unnest(v) AS t, unnest(range(len(v))) AS o FROM (SELECT DISTINCT v FROM win)) LEFT JOIN freq ON t = term GROUP BY v
), near AS (
  SELECT DISTINCT doc_id, v FROM pos JOIN seed ON w[i] = t1 AND list_has_all(list_slice(w, greatest(i - 20, 1), i + 20), v)
), close AS (
  SELECT doc_id, count(DISTINCT item_id) AS ni, count(DISTINCT v) AS nw FROM near JOIN win USING (v) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(ni, 0)::BIGINT AS n_near_items, coalesce(nw, 0)::BIGINT AS n_near_windows
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN close USING (doc_id)
"""
