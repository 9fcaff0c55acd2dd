"""Instant search and hybrid passage ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import collapse, search_fold
from folio.functions.vectors import dequantize, dot
from folio.operators import fuzzy
from folio.staging import fits, staged


def instant_search(index: DataFrame, query: str, first: int = 40, top: int = 15) -> DataFrame:
    """(key, name, rank): the first ``first`` matches in key order, then the best ``top`` of them.

    ``index`` (key, name, sub). A match holds the folded query in its name or its substances; name matches come first,
    then names that begin with it, then short ones. A blank query matches nothing.
    """
    term = search_fold(F.trim(F.lit(query)))
    name, sub = search_fold(F.col("name")), search_fold(F.coalesce("sub", F.lit("")))
    hits = index.filter((term != "") & (name.contains(term) | sub.contains(term))).orderBy("key").limit(first)
    place = [(~name.contains(term)).cast("int"), (~name.startswith(term)).cast("int"), F.length("name"), F.col("key")]
    # both limits are small and fixed, so one task may rank them
    return hits.withColumn("rank", F.row_number().over(W.orderBy(*place))).filter(F.col("rank") <= top).select("key", "name", "rank")


def credit(term: Column, words: Column) -> Column:
    """How well an array of words has a term: 1 exactly, 0.85 as a prefix (both 4 letters or more), 0.7 by small edits."""
    most = F.when(F.length(term) <= 5, F.lit(1)).otherwise(F.lit(2))

    def of(w: Column) -> Column:
        prefix = (F.length(term) >= 4) & (F.length(w) >= 4) & (w.startswith(term) | term.startswith(w))
        near = (F.abs(F.length(term) - F.length(w)) <= most) & F.when(F.length(term) <= 5, F.levenshtein(term, w, 1) >= 0).otherwise(F.levenshtein(term, w, 2) >= 0)
        return F.when(w == term, 1.0).when(prefix, 0.85).when(near, 0.7).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(words, of)), F.lit(0.0))


def lexical_score(terms: Column, words: Column) -> Column:
    """Mean credit of an array of terms; 0 without terms."""
    got = F.transform(terms, lambda t: credit(t, words))
    return F.when(F.size(terms) > 0, F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / F.size(terms)).otherwise(0.0)


def sub_queries(query: str, least: int = 5, most: int = 25, cut: int = 400) -> list[str]:
    """Parts between ``//``: trimmed, distinct, long enough, each cut."""
    out: list[str] = []
    for part in query.split("//"):
        p = part.strip()[:cut]
        if len(p) >= least and p not in out:
            out.append(p)
    return out[:most]


def rank_passages(chunks: DataFrame, queries: DataFrame, floor: float, bonus: float = 0.15, top: int = 25) -> DataFrame:
    """Best passages of one page: (ord, block, cosine, lexical, score, rank).

    ``chunks`` (ord, block, q int8 array, words), ``queries`` (q, terms), at most 25 of them. The score is the mean cosine
    plus ``bonus`` times the mean lexical score; the floor is on the cosine alone; a block comes once, by its best chunk.
    A query of another width than the page's vectors ranks nothing.
    """
    qs = F.broadcast(queries.orderBy(*(["ord"] if "ord" in queries.columns else ["q"])).limit(25).select(F.col("q").alias("qv"), F.col("terms")))
    pairs = chunks.crossJoin(qs)  # at most 25 rows on one side
    scored = pairs.groupBy("ord", "block").agg(
        F.avg(dot(dequantize(F.col("q")), dequantize(F.col("qv")))).alias("cosine"), F.avg(lexical_score(F.col("terms"), F.col("words"))).alias("lexical")
    )
    width = lambda df, c: df.agg(F.min(F.size(c)).alias(f"{c}_lo"), F.max(F.size(c)).alias(f"{c}_hi"))
    fit = width(chunks, "q").crossJoin(width(qs, "qv")).filter("q_lo = q_hi AND qv_lo = qv_hi AND q_lo = qv_lo").select(F.lit(True).alias("all_fit"))  # one row or none
    good = scored.crossJoin(F.broadcast(fit)).filter(F.col("cosine") >= floor).withColumn("score", F.col("cosine") + bonus * F.col("lexical"))
    best = good.withColumn("n", F.row_number().over(W.partitionBy("block").orderBy(F.desc("score"), "ord"))).filter("n = 1")
    return best.orderBy(F.desc("score"), "ord").limit(top).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ord"))).select("ord", "block", "cosine", "lexical", "score", "rank")


def locate(hits: DataFrame, blocks: DataFrame, needle: int = 40, least: int = 8) -> DataFrame:
    """(hit, block): the first block (sec, ord, text) of a hit's (hit, sec, snippet) section that holds the snippet's beginning.

    A beginning of fewer than ``least`` characters, or one that no block holds, gives null: the section's heading.
    """
    norm = lambda c: F.lower(collapse(c))
    h = hits.select("hit", "sec", F.left(norm(F.col("snippet")), F.lit(needle)).alias("n"))
    found = h.filter(F.length("n") >= least).join(blocks.select("sec", "ord", norm(F.col("text")).alias("t")), "sec").filter(F.expr("contains(t, n)")).groupBy("hit").agg(F.min("ord").alias("block"))
    return h.select("hit").join(found, "hit", "left")


def grouped_titles(ranked: DataFrame, *query: str) -> DataFrame:
    """Add ``show_title``: whether a hit's section differs from that of the hit before, within the columns ``query`` (without
    them the hits are one query's, 25 at most)."""
    w = W.partitionBy(*query) if query else W.partitionBy(F.lit(0))
    return ranked.withColumn("show_title", ~F.col("sec").eqNullSafe(F.lag("sec").over(w.orderBy("rank"))))


def display_text(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """(hit, text): the whole block (sec, ord, text) that a hit (hit, sec, snippet) is found in, else its snippet."""
    at = locate(hits, blocks)
    named = hits.join(at, "hit").join(blocks.select("sec", F.col("ord").alias("block"), F.col("text").alias("whole")), ["sec", "block"], "left")
    return named.select("hit", F.coalesce("whole", "snippet").alias("text"))


#: Bytes of query codes that every task holds at most; more queries are taken in slices, one pass over the vectors each.
BROADCAST_CODES, VECTOR_BLOCK = 32 << 20, 2048


def _slices(queries: DataFrame, size: Column) -> int:
    """In how many parts queries are taken whose rows have ``size`` bytes in a task."""
    return max(1, -(-(queries.agg(F.sum(size).alias("b")).first()["b"] or 0) // BROADCAST_CODES))


def _in_slices(queries: DataFrame, run: Callable[[DataFrame], DataFrame], slices: int) -> DataFrame:
    """``run`` on queries (query, ...), as many at a time as fit in what a task may hold."""
    if slices == 1:
        return run(queries)
    part = F.pmod(F.xxhash64("query"), F.lit(slices))
    return reduce(DataFrame.union, [staged(run(queries.filter(part == i)), "slice") for i in range(slices)])


def _matrix(rows: list, width: int, dtype) -> np.ndarray:
    """Vectors of up to ``width`` components as the rows of a matrix, filled up by zeros, which no dot product counts."""
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _codes(column: pa.Array) -> np.ndarray:
    """A column of int8 lists as a matrix."""
    size = np.diff(column.offsets.to_numpy())
    if len(size) and size.min() == size.max() and not column.flatten().null_count:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    rows = column.to_pylist()
    return _matrix(rows, max(map(len, rows), default=0), np.int8)


def _best(v: np.ndarray, q: np.ndarray, least: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, dot product) of each query's ``top`` vectors from ``least`` on, of equal ones the first; by blocks of both."""
    width = max(v.shape[1], q.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(np.float64)  # noqa: E731  exact: sums stay far below 2**53
    v, n = pad(v), len(v)
    for lo in range(0, len(q), 1024):
        # of equal products the earlier vector is greater
        order = np.rint(pad(q[lo : lo + 1024]) @ v.T).astype(np.int64) * n + (n - 1 - np.arange(n))
        if n > top:
            at = np.argpartition(order, n - top, axis=1)[:, n - top :]
            order = np.take_along_axis(order, at, 1)
        else:
            at = np.broadcast_to(np.arange(n), order.shape)
        i, j = np.nonzero(order // n >= least)
        yield lo + i, at[i, j], order[i, j] // n


def nearest(vectors: DataFrame, queries: DataFrame, floor: float, top: int = 25) -> DataFrame:
    """(query, key, cosine, rank): the ``top`` vectors (key, q) of each query (query, q) with a cosine of ``floor`` or more.

    All queries are compared with all vectors: blocks of codes as matrices whose product is exact. A block gives each query's
    best alone, of which the best are taken in a second step; of equal cosines the smaller key comes first. Codes are int8 of unit vectors;
    of different widths the common components count. Keys are longs; rows whose key or codes are null are left out.
    """
    spark = vectors.sparkSession
    vs = vectors.filter("q IS NOT NULL AND key IS NOT NULL").select(F.col("key").cast("long").alias("key"), "q")
    qs = queries.filter("q IS NOT NULL AND query IS NOT NULL").select(F.col("query").cast("long").alias("query"), "q")
    least = math.ceil((floor - 5e-9) * 127 * 127)  # rounded to eight digits it may reach the floor from there on

    def run(part: DataFrame) -> DataFrame:
        got = part.toArrow()  # bounded by _in_slices
        sent = spark.sparkContext.broadcast((got.column(0).to_numpy(), _codes(got.column(1).combine_chunks())))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                order = np.argsort(b.column(0).to_numpy(), kind="stable")
                keys, v = b.column(0).to_numpy()[order], _codes(b.column(1))[order]
                for lo in range(0, len(keys), VECTOR_BLOCK):
                    for i, j, s in _best(v[lo : lo + VECTOR_BLOCK], q, least, top):
                        yield pa.RecordBatch.from_pydict({"query": pa.array(ids[i], pa.int64()), "key": pa.array(keys[lo + j], pa.int64()), "product": pa.array(s, pa.int64())})

        return vs.mapInArrow(scan, "query long, key long, product long")

    scored = _in_slices(qs, run, _slices(qs, F.size("q") + 16)).select("query", "key", F.round(F.col("product") / (127 * 127), 8).alias("cosine")).filter(F.col("cosine") >= floor)
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "key"))).filter(F.col("rank") <= top)


def rank_pages(chunks: DataFrame, queries: DataFrame, sections: DataFrame, floor: float, bonus: float = 0.15, top: int = 25) -> DataFrame:
    """(page, query, ord, block, cosine, lexical, score, rank): each page's best passages for each query.

    ``chunks`` (page, sec, ord, block, q int8 codes), ``sections`` (page, sec, word), ``queries`` (query, sub, q, terms): a query's
    sub-queries count alike. The score is their mean cosine plus ``bonus`` times their mean lexical score on the chunk's section;
    the floor is on the cosine alone; a block comes once a page and query, by its best chunk. A chunk of another width than
    a query is not ranked for it. All queries meet all chunks as matrices, and so do their terms' credits and weights: a chunk
    brings the numbers of its section's words alone, and no row stands for a section and a query or term. A task reads its pages in order and gives
    each page's and query's best alone, of which the best are taken in a second step; a large page is dealt by blocks to PAGE_PARTS tasks at most.
    ord and block are whole numbers, ord is unique within a page; null codes are no chunks.
    """
    spark = chunks.sparkSession
    subs = queries.filter("q IS NOT NULL").select("query", "sub", "q", F.col("terms"))
    # the mean of dot products is the dot product with the mean; sums of codes are whole numbers
    width = subs.groupBy("query").agg(F.count("*").alias("n"), F.min(F.size("q")).alias("w"), F.max(F.size("q")).alias("w1")).filter("w = w1").select("query", "n")
    sums = subs.join(width, "query").select("query", "n", F.posexplode("q").alias("i", "x")).groupBy("query", "n", "i").agg(F.sum(F.col("x").cast("long")).alias("x"))
    totals = sums.groupBy("query", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
    # a term weighs what its credit adds to the mean of the sub-queries' means
    terms = subs.select("query", "sub", F.explode("terms").alias("term")).distinct()
    ids = staged(terms.filter("term <> ''").select("term").distinct().withColumn("id", F.monotonically_increasing_id()), "terms")
    sizes = terms.groupBy("query", "sub").agg(F.count("*").alias("k"))
    weights = terms.join(sizes, ["query", "sub"]).join(width, "query").join(ids, "term").groupBy("query", "id").agg(F.sum(1 / (F.col("k") * F.col("n"))).alias("w"))
    totals = staged(totals.join(weights.groupBy("query").agg(F.collect_list(F.struct("id", "w")).alias("terms")), "query", "left").select("query", "n", "q", _listed("terms", "id long, w double")), "queries")
    found = fuzzy.matches(sections.select("word"), ids.select("term"))
    found = staged(found.join(ids, "term").select("word", "id", "credit"), "matches")
    words = staged(found.select("word").distinct().withColumn("number", F.monotonically_increasing_id()), "words")
    links = staged(found.join(words, "word").select("number", "id", "credit"), "matches")
    few = F.broadcast(words) if fits(words, fuzzy.BROADCAST_MATCHES) else words
    each = sections.join(few, "word").groupBy("page", "sec").agg(F.collect_set("number").alias("words"))
    own = chunks.filter("q IS NOT NULL")
    large = own.groupBy("page").agg(F.count("*").alias("k")).filter(F.col("k") > LARGE_PAGE).select("page", F.lit(True).alias("large"))  # few, as each has many chunks
    part = F.when(F.col("large"), F.pmod(F.xxhash64("block"), F.lit(PAGE_PARTS))).otherwise(0)
    rows = own.join(each, ["page", "sec"], "left").join(F.broadcast(large), "page", "left").select("page", F.col("ord").cast("long").alias("ord"), F.col("block").cast("long").alias("block"), "q", F.coalesce("words", F.array().cast("array<long>")).alias("words"), part.alias("part"))
    cost = F.size("q") * 8 + F.size("terms") * 16 + top * 40 + 16
    # matches go along whole where they are few; else a query pays for those of its terms
    whole = links.count() * MATCH_BYTES <= 4 * BROADCAST_CODES
    if not whole:
        per_term = links.groupBy("id").agg(F.count("*").alias("m"))
        own_terms = totals.select("query", F.explode("terms.id").alias("id")).join(per_term, "id").groupBy("query").agg(F.sum("m").alias("m"))
        totals = staged(totals.join(own_terms, "query", "left"), "queries")
        cost = cost + F.coalesce("m", F.lit(0)) * MATCH_BYTES
    slices = _slices(totals, cost)
    rows = rows if slices == 1 else staged(rows, "chunks")
    # a number of its own, as little of what a task does lies in the bytes that it reads
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "page", "part").sortWithinPartitions("page", "block", "ord").drop("part")
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("page", "ord", "block")} | {"query": queries.schema["query"].dataType.simpleString()}
    kind = f"page {kinds['page']}, query {kinds['query']}, ord long, block long, cosine double, lexical double, score double"

    def run(part: DataFrame) -> DataFrame:
        ours = links if whole else links.join(part.select(F.explode("terms.id").alias("id")).distinct(), "id", "left_semi").select("number", "id", "credit")
        sent = spark.sparkContext.broadcast(_Queries(part.select("query", "n", "q", "terms").toArrow(), ours.toArrow()))  # both bounded by _in_slices

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, page = None, None
            for b in batches:
                at = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
                for lo, hi in zip(edges, edges[1:]):  # noqa: B905
                    name = b.column(0).slice(lo, 1)
                    if best is None or page[0] != name[0]:
                        yield from best.rows(page) if best is not None else ()
                        best, page = _Best(sent.value, top), name
                    for i in range(lo, hi, step := sent.value.step):
                        best.add(b.slice(i, min(step, hi - i)), floor, bonus)
            yield from best.rows(page) if best is not None else ()

        return rows.mapInArrow(rank, kind)

    found = _in_slices(totals, run, slices).withColumns({c: F.col(c).cast(kinds[c]) for c in ("ord", "block")})
    order = (F.desc("score"), F.asc("ord"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("page", "query").orderBy(*order))).filter(F.col("rank") <= top)


#: Chunks from which on a page is dealt to several tasks, and how many at most; queries that meet a block of chunks at once.
LARGE_PAGE, PAGE_PARTS, QUERY_BLOCK = 4096, 16, 256
#: Bytes of a match of a word and a term, of a block of chunks' credits, and matches that are looked up at once.
MATCH_BYTES, CREDIT_BYTES, MATCH_BLOCK = 24, 32 << 20, 1 << 20
#: Scores are whole numbers of this many digits; one that no score is.
DIGITS, NO_SCORE = 8, -(1 << 40)


def _listed(name: str, fields: str) -> Column:
    """An array of structs, empty where it is null."""
    kind = f"array<struct<{','.join(':'.join(f.split()) for f in fields.split(', '))}>>"
    return F.coalesce(F.col(name), F.array().cast(kind)).cast(kind).alias(name)


def _rows(column: pa.Array) -> np.ndarray:
    """The row of each element of a column of lists."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


class _Queries:
    """Queries (query, n, q, terms) as matrices by width, in blocks of QUERY_BLOCK, each with the terms that it weighs; and the
    matches (number, id, credit) of words and terms, the terms of each word beside each other."""

    def __init__(self, got: pa.Table, matches: pa.Table) -> None:
        self.ids, n, q, terms = (c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in got.columns)
        number, term, credit = (c.to_numpy() for c in matches.columns)
        self.terms, place = np.unique(term, return_inverse=True)
        self.values, grade = np.unique(np.concatenate([[0.0], credit]), return_inverse=True)
        self.words, word = np.unique(number, return_inverse=True)
        self.matches = []  # by rising credit
        for g in range(1, len(self.values)):
            at = np.flatnonzero(grade[1:] == g)
            at = at[word[at].argsort(kind="stable")]
            self.matches.append((g, np.searchsorted(word[at], np.arange(len(self.words) + 1)), place[at].astype(np.int32)))
        self.step = max(64, min(VECTOR_BLOCK, CREDIT_BYTES // max(1, len(self.terms))))
        self.blocks, n = [], n.to_numpy(zero_copy_only=False)
        sizes = np.diff(q.offsets.to_numpy())
        for w in np.unique(sizes):
            fit = np.flatnonzero(sizes == w)
            for lo in range(0, len(fit), QUERY_BLOCK):
                at = fit[lo : lo + QUERY_BLOCK]
                take = pa.array(at)
                codes = q.take(take).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(at), w)
                own = terms.take(take)
                row, (term, weight) = _rows(own), (own.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                known = np.isin(term, self.terms)  # what no word matches earns nothing
                names, place = np.unique(term[known], return_inverse=True)
                self.blocks.append((at, codes, n[at].astype(np.float64), np.searchsorted(self.terms, names), (row[known], place, weight[known])))

    def grades(self, words: pa.Array) -> np.ndarray:
        """The best match of each row's words with each term, as a place in ``values``."""
        out = np.zeros((len(words), len(self.terms)), np.uint8)
        if not len(self.terms):
            return out
        row, number = _rows(words), words.flatten().to_numpy(zero_copy_only=False)
        word = np.minimum(np.searchsorted(self.words, number), len(self.words) - 1)
        known = self.words[word] == number
        row, word = row[known], word[known]
        for g, offsets, terms in self.matches:  # a better one comes later
            count = offsets[word + 1] - offsets[word]
            ends = count.cumsum()
            lo = 0
            while lo < len(word):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MATCH_BLOCK, "right")))
                k = count[lo:hi]
                at = np.arange(k.sum()) - np.repeat(k.cumsum() - k, k) + np.repeat(offsets[word[lo:hi]], k)
                out[np.repeat(row[lo:hi], k), terms[at]] = g
                lo = hi
        return out


class _Best:
    """The ``top`` blocks of one page for each query so far."""

    def __init__(self, queries: _Queries, top: int) -> None:
        self.queries, self.top = queries, top
        shape = (len(queries.ids), top)
        self.score, self.ord, self.block = np.full(shape, NO_SCORE), np.zeros(shape, np.int64), np.full(shape, -1)
        self.cosine, self.lexical = np.zeros(shape), np.zeros(shape)

    def add(self, b: pa.RecordBatch, floor: float, bonus: float) -> None:
        """Take in chunks (page, ord, block, q, words) in the order of their blocks."""
        sizes = np.diff(b.column(3).offsets.to_numpy())
        for w in np.unique(sizes):
            part = b if (sizes == w).all() else b.take(pa.array(np.flatnonzero(sizes == w)))
            ords, blocks = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            v, grades = _codes(part.column(3)).astype(np.float64), self.queries.grades(part.column(4))
            starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            by_ord = ords.argsort(kind="stable")
            late = len(ords) - 1 - by_ord.argsort()  # greatest for the first
            for q in self.queries.blocks:
                if q[1].shape[1] == w:
                    self._meet(q, v, grades, ords, blocks, starts, by_ord, late, floor, bonus)

    def _meet(self, q: tuple, v: np.ndarray, grades: np.ndarray, ords: np.ndarray, blocks: np.ndarray, starts: np.ndarray, by_ord: np.ndarray, late: np.ndarray, floor: float, bonus: float) -> None:
        at, codes, n, names, (row, place, weight) = q
        size = len(v)
        cosine = np.round((codes.astype(np.float64) @ v.T) / n[:, None] / (127 * 127), DIGITS)
        lexical = np.zeros_like(cosine)
        if len(names):
            weights = np.zeros((len(at), len(names)))
            weights[row, place] = weight
            lexical = weights @ self.queries.values[grades[:, names]].T
        score = np.where(cosine >= floor, np.rint((cosine + bonus * lexical) * 10**DIGITS), NO_SCORE).astype(np.int64)
        # of a block's equal scores the first by ord is greatest, and of equal blocks'
        order = np.maximum.reduceat(score * size + late, starts, axis=1)
        if len(starts) > self.top:
            order = np.take_along_axis(order, np.argpartition(order, len(starts) - self.top, axis=1)[:, len(starts) - self.top :], 1)
        found = by_ord[size - 1 - order % size]
        new = (order // size, ords[found], blocks[found], np.take_along_axis(cosine, found, 1), np.take_along_axis(lexical, found, 1))
        score, ord_, block, cosine, lexical = (np.concatenate([old[at], x], axis=1) for old, x in zip((self.score, self.ord, self.block, self.cosine, self.lexical), new, strict=True))
        # a block may go on from the chunks before: its better place counts
        near = np.lexsort((ord_, -score, block), axis=1)
        same = np.take_along_axis(block, near, 1)
        again = np.zeros_like(near, dtype=bool)
        again[:, 1:] = same[:, 1:] == same[:, :-1]
        np.put_along_axis(score, near, np.where(again, NO_SCORE, np.take_along_axis(score, near, 1)), 1)
        keep = np.lexsort((ord_, -score), axis=1)[:, : self.top]
        for old, x in zip((self.score, self.ord, self.block, self.cosine, self.lexical), (score, ord_, block, cosine, lexical), strict=True):
            old[at] = np.take_along_axis(x, keep, 1)

    def rows(self, page: pa.Array) -> Iterator[pa.RecordBatch]:
        """(page, query, ord, block, cosine, lexical, score) of what is kept."""
        for lo in range(0, len(self.score), 4096):
            i, j = np.nonzero(self.score[lo : lo + 4096] > NO_SCORE)
            i += lo
            if len(i):
                yield pa.RecordBatch.from_pydict({"page": page.take(pa.array(np.zeros(len(i), np.int64))), "query": self.queries.ids.take(pa.array(i)), "ord": self.ord[i, j], "block": self.block[i, j], "cosine": self.cosine[i, j], "lexical": self.lexical[i, j], "score": self.score[i, j] / 10**DIGITS})
