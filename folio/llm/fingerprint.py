"""Operator 6: document fingerprints, bottom-k sketches of hashed shingles.

A fingerprint is the K least hashes of a text's distinct five-word shingles, in order. Sketches of parts merge
into the sketch of the whole, and two of them estimate resemblance, containment and the number of distinct shingles.
Hashes are the first 16 hexadecimal digits of md5, so that any engine can make the same sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folio.llm.common import materialize, words_of

K, WORDS = 64, 5


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """array<string>: the hash of each run of ``size`` words (of all words, where there are fewer); empty without words."""
    w = words_of(text)

    def runs(words: Column) -> Column:
        last = F.greatest(F.size(words) - size, F.lit(0))
        return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.md5(F.array_join(F.slice(words, i + 1, size), " ").cast("binary")), 1, 16))).otherwise(F.array().cast("array<string>"))

    # the words are bound to a variable, so that they are made once and not for each run
    return F.get(F.transform(F.array(w), runs), F.lit(0))


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together, from their sketches."""
    return bottom_k(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch that both hold; 1 for two empty ones, 0 for one."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def _fraction(h: Column) -> Column:
    """A hash as a number from 0 to 1; 13 digits are what a double can hold."""
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 1.0) / float(16**13)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / _fraction(F.get(a, F.lit(k - 1))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    joint = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / distinct_count(a, k)))


#: Text of a range of documents, at most about so much however large the table; smaller tables have a range a shuffle partition.
RANGE_BYTES = 64 << 20


def _part_of(doc_id: Column, bounds: list) -> Column:
    """The number of bounds that are not above an id, looked up in two steps; 0 for null."""
    step = max(1, math.isqrt(max(len(bounds), 1)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    array = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<long>")
    coarse = F.greatest(below(array([g[0] for g in groups if g])), F.lit(1))
    fine = F.element_at(F.array(*map(array, groups)), coarse)
    return F.when(doc_id.isNull(), 0).otherwise((coarse - 1) * step + below(fine))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, fingerprint, next_head, next_fingerprint): each row with the beginning of the next document's text.

    Rows are in order of (doc_id, text), null ids first; the last is followed by the first. They are dealt into ranges
    of about equally many ids, by quantiles over all of them; a range is put in order by one task, and across ranges only the
    first row of each is looked at. The texts are shuffled once. ``next_head`` is as long as a quarter of the row's text.
    """
    (bounds,) = docs.agg(F.approx_percentile("doc_id", [i / parts for i in range(1, parts)], 10_000)).first() if parts > 1 else (None,)
    placed = docs.withColumn("part", _part_of(F.col("doc_id"), sorted(set(bounds or []))))
    firsts = materialize(placed.groupBy("part").agg(F.min(F.struct("doc_id")).alias("f")).select("part", F.col("f.doc_id").alias("first")), "firsts")  # one row a range
    after = firsts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy(F.lit(0)))).alias("after"))
    heads = placed.alias("d").join(F.broadcast(firsts.alias("f")), (F.col("d.part") == F.col("f.part")) & F.col("d.doc_id").eqNullSafe(F.col("f.first"))).groupBy(F.col("d.part").alias("after")).agg(F.min("text").alias("edge_text"))
    edges = materialize(after.join(heads, "after").select("part", "edge_text", bottom_k(shingle_hashes(F.col("edge_text"))).alias("edge_fingerprint")), "edges")
    # a range goes to the task of its number, so that none is dealt two while another has none
    own = placed.withColumn("part", F.col("part").cast("int")).repartitionById(parts, "part").withColumn("fingerprint", bottom_k(shingle_hashes(F.col("text"))))
    w = W.partitionBy("part").orderBy("doc_id", "text")
    own = own.withColumn("lead_text", F.lead("text").over(w)).withColumn("lead_fingerprint", F.lead("fingerprint").over(w))
    quarter = F.floor(F.length("text") / 4).cast("int")
    return own.join(edges, "part").select(
        "doc_id", "text", "fingerprint", F.substring(F.coalesce("lead_text", "edge_text"), F.lit(1), quarter).alias("next_head"), F.coalesce("lead_fingerprint", "edge_fingerprint").alias("next_fingerprint")
    )


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """``docs`` with fingerprint array<string>; null and empty texts have an empty one. A column of that name is replaced."""
    return docs.withColumn("fingerprint", bottom_k(shingle_hashes(F.col(text)), k))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, both fingerprints and likenesses of each row: with its edit and with the next document.

    The edit puts the first floor(n/4) code points (or all) of the next document for as many last ones of the text. A null
    text is empty. Next is the next row in order of (doc_id, text), null ids first, so that rows that share an id, or are
    repeated, follow each other; the last row is followed by the first, and a single one by itself.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    row = with_next(texts, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    row = row.withColumn("n_chars", F.length("text").cast("long"))
    row = row.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.col("next_head")))
    row = row.withColumn("edited_fingerprint", F.when(F.col("edited") == F.col("text"), F.col("fingerprint")).otherwise(bottom_k(shingle_hashes(F.col("edited")))))
    return row.select(
        "doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint",
        resemblance(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        resemblance(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        distinct_count(F.col("fingerprint")).alias("n_shingles"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`neighbours`, rounded nowhere; fingerprints as one string."""
    return neighbours(docs).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array_join("fingerprint", "").alias("fingerprint"), F.array_join("edited_fingerprint", "").alias("edited_fingerprint"), "near_edited", "near_next")


def _sql() -> str:
    words = r"list_filter(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    sketch = lambda w: f"list_sort(list_distinct(list_transform(range(1, greatest(len({w}) - {WORDS}, 0) + 2), lambda i: substr(md5(array_to_string({w}[i:i + {WORDS - 1}], ' ')), 1, 16))))[1:{K}]"
    near = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(list_sort(list_distinct(list_concat({a}, {b})))[1:{K}], {a}), {b}))::DOUBLE / len(list_sort(list_distinct(list_concat({a}, {b})))[1:{K}]) END"
    return f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nt FROM documents
), e AS (
  SELECT *, left(t, n - n // 4) || left(nt, n // 4) AS x FROM a
), w AS (
  SELECT doc_id, n, x, {words} AS wt, {words.replace('(t,', '(x,')} AS wx, {words.replace('(t,', '(nt,')} AS wn FROM e
), s AS (
  SELECT doc_id, n, x, CASE WHEN len(wt) = 0 THEN []::VARCHAR[] ELSE {sketch('wt')} END AS ft, CASE WHEN len(wx) = 0 THEN []::VARCHAR[] ELSE {sketch('wx')} END AS fx, CASE WHEN len(wn) = 0 THEN []::VARCHAR[] ELSE {sketch('wn')} END AS fn FROM w
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(x) AS edited_sha256, array_to_string(ft, '') AS fingerprint, array_to_string(fx, '') AS edited_fingerprint,
  {near('ft', 'fx')} AS near_edited, {near('ft', 'fn')} AS near_next
FROM s
"""


SQL = _sql()
