"""Scoring and linking of catalog entries: token matches, arg-max dictionaries, groups and siblings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import auth_key, linkable_words, slug, tokens
from folio.functions.word_lists import LINK_STOP
from folio.operators.selection import exact_percentile
from folio.staging import staged


def signals(entries: DataFrame, *pools: DataFrame) -> DataFrame:
    """(key, tokens): tokens of the names of (key, name) and of further (key, tokens) pools, for keys of ``entries`` only."""
    parts = entries.select("key", F.explode_outer(tokens(F.col("name"))).alias("t"))
    keys = entries.select("key").distinct()
    for p in pools:
        parts = parts.unionByName(p.join(keys, "key", "left_semi").select("key", F.explode_outer("tokens").alias("t")))
    return parts.groupBy("key").agg(F.collect_set("t").alias("tokens"))


def fallback_score(scores: DataFrame, p: float = 0.25) -> DataFrame:
    """One row: the exact percentile of every score, found by selection; 0 without any."""
    found = exact_percentile(scores.select(F.col("score").alias("v")), p)
    return scores.sparkSession.createDataFrame([(0.0 if found is None else found,)], "fallback double")


def score(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, score, matched): the best score of a term all of whose tokens an entry (key, tokens) has, else the fallback.

    A term is looked up under its rarest token alone, and containment is tested on what that finds; a term with a token
    that no entry has is left out.
    """
    # equal token sets are one term: their best score counts, and the join stays small
    wanted = terms.select(F.array_sort(tokens(F.col("term"))).alias("tt"), "score").filter("size(tt) > 0").groupBy("tt").agg(F.max("score").alias("score"))
    held = entries.select("key", "tokens", F.explode("tokens").alias("t"))
    each = wanted.select("tt", "score", F.explode("tt").alias("t"))
    counts = held.groupBy("t").agg(F.count("*").alias("k")).join(each.select("t").distinct(), "t", "left_semi")
    rare = each.join(counts, "t", "left").groupBy("tt", "score").agg(F.min_by("t", F.struct(F.coalesce("k", F.lit(0)), "t")).alias("t"))
    hits = held.join(rare, "t").filter(F.size(F.array_except("tt", "tokens")) == 0)
    best = hits.groupBy("key").agg(F.max("score").alias("best"))
    return entries.select("key").join(best, "key", "left").crossJoin(F.broadcast(fallback_score(terms))).select("key", F.coalesce("best", "fallback").alias("score"), F.col("best").isNotNull().alias("matched"))


def link_terms(entries: DataFrame, comp: DataFrame, scores: DataFrame, whitelist: DataFrame, pages: DataFrame, names: DataFrame, least: int = 6) -> DataFrame:
    """(term, key, slug, name): for each linkable term the best entry that has a page.

    ``entries`` (key, name, file_order), ``comp`` (key, n_links, tokens). Brand terms are the first word of a name before
    a comma, one alphabetic word; substance terms need exactly one active part, brands count a missing one as one. The
    best is by (one active part, score, earliest in the file); a winner without a name drops the term.
    """
    first = F.get(F.split(F.trim(F.split_part("name", F.lit(","), F.lit(1))), r"(?U)\s+"), F.lit(0))
    joined = entries.join(comp, "key", "left")
    brand = joined.filter(first.rlike(r"^\p{L}+$")).select(F.explode(tokens(first)).alias("term"), "key", "file_order", (F.coalesce("n_links", F.lit(0)) <= 1).alias("mono"))
    parts = joined.filter("n_links = 1").select(F.explode("tokens").alias("term"), "key", "file_order", F.lit(True).alias("mono"))
    ok = (F.length("term") >= least) & F.col("term").rlike("^[A-Z]+$") & ~F.col("term").isin(*sorted(LINK_STOP))
    cand = brand.union(parts).filter(ok).join(whitelist.select("term").distinct(), "term", "left_semi").join(pages.select("key").distinct(), "key", "left_semi").join(scores.select("key", "score"), "key", "left")
    best = cand.groupBy("term").agg(F.max_by("key", F.struct("mono", F.coalesce("score", F.lit(0.0)), -F.col("file_order"))).alias("key"))
    return best.join(names.filter("name <> ''"), "key").select("term", "key", F.concat_ws("-", "key", slug(F.col("name"))).alias("slug"), "name")


#: Bytes of link terms that are broadcast at once, and of a term beside its letters; more of them take more passes over the documents.
BROADCAST_BYTES, TERM_BYTES = 128 << 20, 96


def links_in_text(docs: DataFrame, terms: DataFrame, budget: int = 15) -> DataFrame:
    """(key, ord, term, target): the first whole-word occurrence of each term in (key, text), without links to itself.

    Words are runs of letters and digits of the folded text. At most ``budget`` links a document, in order of their first
    place (the feature's own limit). Only words that are terms leave the row that holds them, and of these the first ``budget``.
    """
    words = docs.select("key", F.posexplode(linkable_words(F.col("text"))).alias("ord", "term"))
    named = staged(terms.select("term", F.col("key").alias("target")), "terms")
    passes = max(1, -(-(named.agg(F.sum(F.length("term") + TERM_BYTES).alias("b")).first()["b"] or 0) // BROADCAST_BYTES))

    def first(part: DataFrame) -> DataFrame:
        hits = words.join(F.broadcast(part), "term").filter("key <> target")
        return hits.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("ord"))).filter(F.col("n") <= budget)

    if passes == 1:
        got = first(named)
    else:
        share = F.pmod(F.xxhash64("term"), F.lit(passes))
        each = [staged(first(named.filter(share == i)).drop("n"), "links") for i in range(passes)]
        got = reduce(DataFrame.unionAll, each).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("ord"))).filter(F.col("n") <= budget)
    return got.select("key", F.col("n").alias("ord"), "term", "target")


def linked_targets(links: DataFrame) -> DataFrame:
    """(key, targets): distinct targets in the order of their first link."""
    first = links.groupBy("key", "target").agg(F.min("ord").alias("ord"))
    return first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("targets"))


def ordered_distinct_text(rows: DataFrame, key: str, text: Column, order: str, sep: str = " ") -> DataFrame:
    """(key, text): a key's distinct texts, upper and lower case alike, in order of their first row."""
    first = rows.select(F.col(key), text.alias("s"), F.col(order).alias("o")).filter("s <> ''").groupBy(key, F.lower("s").alias("l")).agg(F.min(F.struct("o", "s")).alias("x"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), sep).alias("text"))


def authorization_groups(caps: DataFrame) -> DataFrame:
    """(auth, members): keys of (key, name, eu) with one EU number, or one brand root without a number, in order."""
    return caps.select(auth_key(F.col("eu"), F.col("name")).alias("auth"), "key").groupBy("auth").agg(F.array_sort(F.collect_list("key")).alias("members"))


def borrow(members: DataFrame, order: Column) -> DataFrame:
    """(key, donor): for each key of (auth, key, has, ...) without its own, the sibling that has one and is last in ``order``."""
    donors = members.filter("has").groupBy("auth").agg(F.max_by("key", order).alias("donor"))
    return members.filter("NOT has").join(donors, "auth").select("key", "donor")


def word_prefix_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): the first right name (name, ord) that equals a left name or is one's words at the beginning of the other's.

    Each name is looked up under every prefix of its words, so that both directions are equality joins.
    """
    words = F.split("name", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))
    lp = left.select(F.col("name").alias("l"), F.explode(prefixes).alias("p"))
    rp = right.select(F.col("name").alias("r"), "ord", F.explode(prefixes).alias("p"))
    a = lp.join(right.select(F.col("name").alias("p"), F.col("name").alias("r"), "ord"), "p").select("l", "r", "ord")
    b = rp.join(left.select(F.col("name").alias("p"), F.col("name").alias("l")), "p").select("l", "r", "ord")
    return a.union(b).groupBy("l").agg(F.min_by("r", F.struct((F.col("l") != F.col("r")), "ord")).alias("r"))


def longest_shared_token(left: DataFrame, pages: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(key, token): of an entry's tokens that some page name has, the longest, then the last in order."""
    known = pages.select(F.explode("tokens").alias("t")).distinct()
    got = left.select("key", F.explode("tokens").alias("t")).filter(~F.col("t").isin(*(stop or [""]))).join(known, "t", "left_semi")
    return got.groupBy("key").agg(F.max_by("t", F.struct(F.length("t"), "t")).alias("token"))
