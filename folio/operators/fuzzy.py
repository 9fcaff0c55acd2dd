"""Approximate matches of words and terms by equality joins alone.

Two words within k edits of each other have a string in common that each gives by leaving out at most k characters. Words are
therefore looked up under what they give, prefixes under themselves, and only what meets there is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.staging import fits, staged

EXACT, PREFIX, EDITED = 1.0, 0.85, 0.7
#: A prefix counts from this length on, of either side; longer terms may differ by two edits, up to SHORT letters by one.
LEAST_PREFIX, SHORT = 4, 5
#: Terms whose matches are broadcast at most.
BROADCAST_MATCHES = 200_000


def left_out(word: Column, k: int) -> Column:
    """The distinct strings that a word gives by leaving out up to ``k`` characters, itself among them."""

    def once(w: Column) -> Column:
        drop = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, drop).otherwise(F.array().cast("array<string>"))

    out = F.array(word)
    for _ in range(k):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, once))))
    return out


def _within(words: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(term, word) at most ``k`` edits apart."""
    lengths = terms.agg(F.min(F.length("term")).alias("lo"), F.max(F.length("term")).alias("hi"))  # one row
    near = words.crossJoin(F.broadcast(lengths)).filter((F.length("word") >= F.col("lo") - k) & (F.length("word") <= F.col("hi") + k))
    give = lambda df, c: df.select(c, F.explode(left_out(F.col(c), k)).alias("g")).select(c, F.xxhash64("g").alias("g"))
    # short strings are given by many: words of the same beginnings meet once a pair, and only then are compared
    pairs = give(near, "word").join(give(terms, "term"), "g").select("term", "word").distinct()
    return pairs.filter(F.levenshtein("term", "word", k) >= 0)


def matches(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, word, credit) of every term and word that match, of (word) and (term): 1 for equal ones, 0.85 where one begins
    the other (both of four letters or more), 0.7 within one edit, or two for terms of more than five letters.

    Repeated words and terms count once; nulls and empty strings match nothing.
    """
    # both are read by every kind of match and come from whole texts as a rule; words are few bytes but much work, so every core gets some
    cores = words.sparkSession.sparkContext.defaultParallelism
    w, t = (staged(df.select(c).filter(f"{c} <> ''").distinct().repartition(cores, c), c) for df, c in ((words, "word"), (terms, "term")))
    lengths = t.filter(F.length("term") >= LEAST_PREFIX).agg(F.collect_set(F.length("term")).alias("ns"))  # one row, a number a length
    begins = w.crossJoin(F.broadcast(lengths)).select("word", F.explode(F.filter("ns", lambda n: n < F.length("word"))).alias("n"))
    longer = begins.select("word", F.left("word", F.col("n")).alias("term")).join(t, "term").select("term", "word")
    heads = t.filter(F.length("term") > LEAST_PREFIX).select("term", F.explode(F.transform(F.sequence(F.lit(LEAST_PREFIX), F.length("term") - 1), lambda n: F.left("term", n))).alias("word"))
    shorter = heads.join(w, "word").select("term", "word")
    short, long = t.filter(F.length("term") <= SHORT), t.filter(F.length("term") > SHORT)
    graded = [
        t.join(w, t["term"] == w["word"]).select("term", "word", F.lit(EXACT).alias("credit")),
        longer.union(shorter).select("term", "word", F.lit(PREFIX).alias("credit")),
        _within(w, short, 1).union(_within(w, long, 2)).select("term", "word", F.lit(EDITED).alias("credit")),
    ]
    return graded[0].union(graded[1]).union(graded[2]).groupBy("term", "word").agg(F.max("credit").alias("credit"))


def lexical_scores(held: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, query, lexical): how well rows (key, word) have the terms of each query (query, term): the mean over its
    distinct terms of the best credit that a word of the row earns. Rows and queries that share nothing are left out.

    Only words that match some term leave the row that holds them; their matches are broadcast where they are few.
    """
    wanted = terms.select("query", "term").distinct()
    found = staged(matches(held.select("word"), wanted.select("term")), "matches")
    found = F.broadcast(found) if fits(found, BROADCAST_MATCHES) else found
    best = held.select("key", "word").join(found, "word").groupBy("key", "term").agg(F.max("credit").alias("credit"))
    sizes = wanted.groupBy("query").agg(F.count("*").alias("n"))
    return best.join(wanted, "term").groupBy("key", "query").agg(F.sum("credit").alias("s")).join(sizes, "query").select("key", "query", (F.col("s") / F.col("n")).alias("lexical"))
