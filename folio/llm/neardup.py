"""Operator 3: near-duplicate classes by improved consistent weighted sampling.

Equal texts are one. What is left is cut into shingles of five words, weighted by TF-IDF; samples drawn in
proportion to the weights (Ioffe's scheme) agree for two texts as often as their weighted Jaccard similarity says.
Texts that agree in a whole band of samples share a bucket. A bucket's texts are compared within a task, where the
similarity itself is computed, and only links that connect what was not connected before come out: at most one less
than there are texts. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop_tables, give_back, materialize, release_shuffles, small_batches, small_enough
from folio.llm.graph import components
from folio.llm.ngrams import powers

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 13, 3
#: The first BANDS * ROWS samples make the bands; all of them estimate the similarity of a candidate.
SAMPLES = 96
#: Buckets of the document-frequency table, of a fixed size whatever the input: a shingle's count is its bucket's.
DF_BITS = 17
#: The part of a weight that the idf moves: weights lie between 1 - IDF_PART and 1 (times the term's own part), so
#: that a large group of near copies, whose shingles are frequent by their own number, does not lose its links.
IDF_PART = 0.25
#: Share of agreeing samples from which a pair is verified: 0.8 less five standard deviations of the estimate.
LEAST_AGREEING = 0.6
#: Bands are looked at in rounds; a later round leaves out the buckets that earlier ones have made one class.
ROUNDS = ((0, 4), (4, BANDS))
#: Texts of a block, which one task compares. Where more than SPLIT texts of a bucket stand beside its largest class,
#: the bucket is split by each further band; after LEVELS bands all blocks of what is left meet.
GROUP, SPLIT, LEVELS = 512, 16 * 512, 3
#: Rows that are dropped and broadcast at most; more of them meet the documents by shuffle. The same in bytes for texts with the
#: places in which they are compared, some PLACE_BYTES each.
BROADCAST_TEXTS, BROADCAST_BYTES, PLACE_BYTES = 300_000, 16 << 20, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased; digits, letters and all beyond ASCII), in order."""
    b = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _IN_WORD[b]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    return mix(np.add.reduceat((b[inside[1:-1]].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place], first) + length.astype(np.uint64))


def shingles(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 32-bit shingle hashes in order of value, their counts); fewer words than ``size`` are one shingle."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    n, p = min(size, len(w)), powers(size)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h += w[i : i + len(h)] * p[n - 1 - i]
    ids, counts = np.unique((mix(h + np.uint64(n)) >> np.uint64(32)).astype(np.uint32), return_counts=True)
    return ids, counts.astype(np.uint32)


def weigh(ids: np.ndarray, counts: np.ndarray, idf_share: np.ndarray) -> np.ndarray:
    """TF-IDF weights; ``idf_share`` holds the idf of each bucket as a share of the greatest."""
    return ((1.0 + np.log(counts)) * (1.0 - IDF_PART + IDF_PART * idf_share[ids >> np.uint32(32 - DF_BITS)])).astype(np.float32)


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by Newton's method on 1 - (1 + x) exp(-x)."""
    q = (np.arange(n) + 0.5) / n
    x = np.full(n, 1.7)
    for _ in range(200):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-12) * 0.7, 1e-6)
    return x.astype(np.float32)


_GAMMA = _gamma2_quantiles(1 << 12)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BLOCK = 1 << 15


def samples(ids: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, SAMPLES) uint32: for each, the bits of the least draw among its shingles; equal draws are equal samples.

    Document i has the places offsets[i] to offsets[i + 1], of which none may be empty. For a shingle of weight w, with
    r and c from Gamma(2, 1) and b uniform, all fixed by the shingle: t = floor(ln w / r + b) and the draw is
    ln c - r (t - b + 1).
    """
    out = np.full((len(offsets) - 1, SAMPLES), np.inf, np.float32)
    for lo in range(0, len(ids), _BLOCK):
        hi = min(lo + _BLOCK, len(ids))
        first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
        cuts = np.maximum(offsets[first:last], lo) - lo
        key, log_w = ids[lo:hi].astype(np.uint64) + np.uint64(1), np.log(weights[lo:hi])
        for k in range(SAMPLES):
            x = mix(key * _SEEDS[k])
            y = (x * _MIX2) ^ (x >> np.uint64(29))
            r = _GAMMA[x & np.uint64(0xFFF)]
            b = ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(1 / (1 << 24))
            u = ((y >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * ((y & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5))
            t = np.floor(log_w / r + b)
            a = np.log(np.maximum(np.float32(44.36142) - np.log(u), np.float32(1e-30))) - r * (t - b + np.float32(1))  # 64 ln 2
            out[first:last, k] = np.minimum(out[first:last, k], np.minimum.reduceat(a, cuts))
    return out.view(np.uint32)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(rep, key, least, *shingles(t)) for rep, key, least, t in zip(b["rep"], b["key"], b["least"], b["text"], strict=True)]
        yield pd.DataFrame([(*of, ids.tobytes(), counts.tobytes()) for *of, ids, counts in rows if len(ids)], columns=["rep", "key", "least", "ids", "counts"])
    give_back()


def _read(ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.uint32), np.frombuffer(counts, np.uint32)


def idf_shares(features: DataFrame) -> np.ndarray:
    """The idf of each bucket over all texts, as a share of the greatest possible.

    In a large table every bucket holds some rare shingles. That load is the same everywhere, up to its noise, and is taken
    off as the median of all buckets: what is left is the count of a frequent shingle, at any size of the input.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros((1 << DF_BITS) + 1, np.int64), 0
        for b in batches:
            for ids in b["ids"]:
                n += 1
                df[np.unique(np.frombuffer(ids, np.uint32) >> np.uint32(32 - DF_BITS))] += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": at, "n": df[at]})

    got = features.select("ids").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << DF_BITS) + 1, np.int64)
    df[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    n, own = max(int(df[-1]), 1), np.maximum(df[:-1] - np.median(df[:-1]), 0)
    return (np.log((1.0 + n) / (1.0 + own)) / np.log(1.0 + n)).clip(0, 1).astype(np.float32)


def _sampler(shared):
    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            pairs = [_read(i, c) for i, c in zip(b["ids"], b["counts"], strict=True)]
            ids = np.concatenate([p[0] for p in pairs])
            offsets = np.concatenate(([0], np.cumsum([len(p[0]) for p in pairs])))
            got = samples(ids, weigh(ids, np.concatenate([p[1] for p in pairs]), shared.value), offsets)
            keys = np.zeros((len(got), BANDS), np.uint64)
            for band in range(BANDS):
                h = np.full(len(got), band + 1, np.uint64)
                for row in range(ROWS):
                    h = mix(h * np.uint64(0x100000001B3) + got[:, band * ROWS + row])
                keys[:, band] = h
            codes = ((got * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            yield pd.DataFrame({"rep": b["rep"], "bands": list(keys.view(np.int64)), "codes": [c.tobytes() for c in codes]})
        give_back()

    return sample


def _block_links(b: dict[str, np.ndarray], lo: int, hi: int, idf_share: np.ndarray) -> list[tuple[int, int, float]]:
    """Of a block, the rows from lo to hi, or of its rows of side 0 with those of side 1: links of SIMILARITY or more that connect
    two classes, with their similarity."""
    n, reps, codes = hi - lo, b["rep"][lo:hi], np.frombuffer(b"".join(b["codes"][lo:hi]), np.uint8).reshape(hi - lo, -1)
    cut = int((b["side"][lo:hi] == 0).sum())
    twice, label = cut < n, b["comp"][lo:hi].copy()
    least_equal, out, place = LEAST_AGREEING * codes.shape[1], [], None
    for a in range(cut):
        after = cut if twice else a + 1
        to = after + np.flatnonzero(label[after:] != label[a])
        to = to[np.count_nonzero(codes[to] == codes[a], axis=1) >= least_equal] if len(to) else to
        if not len(to):
            continue
        if place is None:  # the shingles are read once a pair is to be verified
            read = [_read(i, c) for i, c in zip(b["ids"][lo:hi], b["counts"][lo:hi], strict=True)]
            ids = np.concatenate([r[0] for r in read])
            offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in read])))
            w = weigh(ids, np.concatenate([r[1] for r in read]), idf_share)
            sums = np.add.reduceat(w, offsets[:-1], dtype=np.float64)
            kinds, place = np.unique(ids, return_inverse=True)
            dense = np.zeros(len(kinds), np.float32)
        own = slice(offsets[a], offsets[a + 1])
        dense[place[own]] = w[own]
        length = offsets[to + 1] - offsets[to]
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(offsets[to] - first, length)
        least = np.add.reduceat(np.minimum(dense[place[at]], w[at]), first, dtype=np.float64)
        dense[place[own]] = 0
        close = np.flatnonzero(least >= SIMILARITY * (sums[a] + sums[to] - least))
        if len(close):
            linked, alike = to[close], (least / (sums[a] + sums[to] - least))[close]
            met, at = np.unique(label[linked], return_index=True)
            out += [(int(reps[a]), r, x) for r, x in zip(reps[linked[at]].tolist(), alike[at].tolist(), strict=True)]
            label[np.isin(label, met)] = label[a]
    return out


def _linker(shared):
    """Rows in order of (key, i, j, side); a block may go on from one batch to the next."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> tuple[pd.DataFrame, int]:
            """The links of all blocks but the last, and where that begins."""
            b = {c: rows[c].to_numpy() for c in rows.columns}
            new = np.zeros(len(rows), bool)
            for c in ("key", "i", "j"):
                new[1:] |= b[c][1:] != b[c][:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            out = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo > 1 for x in _block_links(b, lo, hi, shared.value)]
            return pd.DataFrame(out, columns=["src", "dst", "similarity"]).astype({"src": np.int64, "dst": np.int64, "similarity": np.float64}), cuts[-1]

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            ends = held[0].iloc[-1][["key", "i", "j"]], b.iloc[-1][["key", "i", "j"]]
            if len(held) > 1 and (ends[0] == ends[1]).all():
                continue  # still the block that was held
            rows = pd.concat(held, ignore_index=True)
            links, cut = done(rows)
            held = [rows.iloc[cut:].reset_index(drop=True)]
            yield links
        if held:
            rows = pd.concat(held, ignore_index=True)
            end = rows.iloc[:1].assign(key=rows["key"].iloc[-1] ^ 1)  # another block, so that the last one ends
            yield done(pd.concat([rows, end], ignore_index=True))[0]
        give_back()

    return link


class _Linking:
    """Links found so far, and the classes that they make."""

    def __init__(self, features: DataFrame, sampled: DataFrame, shared):
        self.spark, self.features, self.sampled, self.shared = features.sparkSession, features, sampled, shared
        self.classes: DataFrame | None = None  # (node, component) of linked texts
        self.found: list[DataFrame] = []  # (src, dst, similarity)

    def joined(self, rows: DataFrame) -> DataFrame:
        """``rows`` (rep, ...) with comp, the class of a text so far."""
        if self.classes is None:
            return rows.withColumn("comp", F.col("rep"))
        return rows.join(self.classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")

    def compare(self, tasks: DataFrame) -> None:
        """Link the texts of ``tasks`` (rep, comp, key, i, j, side) that share (key, i, j); ``classes`` are brought up to date."""
        at = tasks.groupBy("rep").agg(F.first("comp").alias("comp"), F.collect_list(F.struct("key", "i", "j", "side")).alias("at"))
        at = materialize(at, "tasks")
        size = at.agg(F.sum(F.size("at") * PLACE_BYTES + PLACE_BYTES).alias("b")).first()["b"] or 0
        near = F.broadcast(at) if size <= BROADCAST_BYTES else at
        # one row a text until it is copied to its tasks
        rows = self.features.join(near, "rep").join(self.sampled.select("rep", "codes"), "rep").select("rep", "comp", "codes", "ids", "counts", F.explode("at").alias("x")).select("*", "x.*").drop("x")
        # many blocks are small: they go through a task one after the other, without a frame for each
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "rep")
        links = materialize(rows.mapInPandas(_linker(self.shared), "src long, dst long, similarity double"), "links")
        release_shuffles(self.spark)
        before, edges = self.classes, links.select("src", "dst")
        if links.limit(1).count():
            self.classes = materialize(components(edges if before is None else edges.union(before)), "components")
            self.found.append(links)
            drop_tables(*([before] if before is not None else []))
        else:
            drop_tables(links)
        drop_tables(at)

    def named(self) -> DataFrame:
        """(key, class_id, class_key, n_links, linked_id, similarity) of the linked texts.

        A class is named by the least (doc_id, key) of its texts; of a text's links, which are as few as connect its class, the
        one of the greatest similarity is given, by the least doc_id of the text at its other end.
        """
        texts = self.features.select("rep", "key", "least")
        if self.classes is None:
            none = texts.limit(0)
            return none.select("key", F.col("least").alias("class_id"), F.col("key").alias("class_key"), F.lit(0).cast("long").alias("n_links"), F.col("least").alias("linked_id"), F.lit(0.0).alias("similarity"))
        linked = materialize(texts.join(self.classes.withColumnRenamed("node", "rep"), "rep"), "linked")
        heads = linked.groupBy("component").agg(F.min(F.struct("least", "key")).alias("head"))
        links = reduce(DataFrame.union, self.found)
        other = links.join(linked.select(F.col("rep").alias("dst"), F.col("least").alias("b")), "dst").join(linked.select(F.col("rep").alias("src"), F.col("least").alias("a")), "src")
        both = other.select(F.col("src").alias("rep"), F.col("b").alias("to"), "similarity").union(other.select(F.col("dst").alias("rep"), F.col("a").alias("to"), "similarity"))
        best = both.groupBy("rep").agg(F.count("*").alias("n_links"), F.max(F.struct("similarity", -F.col("to"))).alias("x"))
        got = linked.join(heads, "component").join(best, "rep")
        out = materialize(got.select("key", F.col("head.least").alias("class_id"), F.col("head.key").alias("class_key"), "n_links", (-F.col("x.col2")).alias("linked_id"), "x.similarity"), "named")
        drop_tables(linked, self.classes, *self.found)
        return out

    def resolve(self, buckets: DataFrame, level: int = 1) -> None:
        """Link all texts of ``buckets`` (rep, key, used) that share a key; ``used`` are the bands that a key is made of."""
        rows = self.joined(buckets)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "n")
        rows = materialize(rows.join(sizes, "key"), "buckets")
        zero = F.lit(0).cast("long")
        self.compare(rows.select("rep", "comp", "key", F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("n") / GROUP)).alias("i"), zero.alias("j"), F.lit(0).alias("side")))
        large = rows.filter(f"n > {GROUP}").select("rep", "key", "used")
        if large.limit(1).count():
            self.across(large, level)
        drop_tables(rows)

    def across(self, buckets: DataFrame, level: int) -> None:
        """Links between the blocks of large buckets: whatever is not of a bucket's largest class meets all of the bucket."""
        rows = self.joined(buckets)
        each = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
        sizes = each.agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", "c").alias("main")).withColumn("open", F.col("n") - F.col("most")).filter("open > 0").drop("most")
        rows = materialize(rows.join(sizes, "key"), "buckets")
        split = rows.filter(f"open > {SPLIT}") if level < LEVELS else rows.limit(0)
        met = rows.filter(f"open <= {SPLIT}") if level < LEVELS else rows
        blocks = lambda c: F.ceil(F.col(c) / GROUP).cast("long")
        met = met.select("rep", "comp", "key", "main", F.pmod(F.xxhash64("rep", "key"), blocks("open")).alias("i"), blocks("open").alias("n_i"), F.pmod(F.xxhash64("key", "rep"), blocks("n")).alias("j"), blocks("n").alias("n_j"))
        zero = F.lit(0).cast("long")
        left = met.filter("comp <> main").select("rep", "comp", "key", "i", F.explode(F.sequence(zero, F.col("n_j") - 1)).alias("j"), F.lit(0).alias("side"))
        right = met.select("rep", "comp", "key", F.explode(F.sequence(zero, F.col("n_i") - 1)).alias("i"), "j", F.lit(1).alias("side"))
        if met.limit(1).count():
            self.compare(left.union(right))
        if split.limit(1).count():
            by = split.select("rep", "key", "used").join(self.sampled.select("rep", "bands"), "rep").select("rep", "key", "used", F.explode(F.array_except("bands", "used")).alias("band"))
            self.resolve(by.select("rep", F.xxhash64("key", "band").alias("key"), F.concat("used", F.array("band")).alias("used")), level + 1)
        drop_tables(rows)


def _classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, class_id, class_key, n_links, linked_id, similarity): one row per row of ``docs``.

    key is the md5 of the text; the text that a class is named by has the keys class_id and class_key.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    # copies are merged where they lie, then shuffled. A text gets a number of its own, as one id may have several texts
    texts = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("text").alias("text")).filter("least IS NOT NULL").withColumn("rep", F.monotonically_increasing_id())
    features = materialize(texts.select("rep", "key", "least", "text").mapInPandas(_features, "rep long, key string, least long, ids binary, counts binary"), "shingles")
    release_shuffles(spark)  # that of the texts
    shared = spark.sparkContext.broadcast(idf_shares(features))  # 2**DF_BITS numbers
    sampled = materialize(features.select("rep", "ids", "counts").mapInPandas(_sampler(shared), "rep long, bands array<long>, codes binary"), "samples")
    linking = _Linking(features, sampled, shared)
    for lo, hi in ROUNDS:
        banded = sampled.select("rep", F.explode(F.slice("bands", lo + 1, hi - lo)).alias("key"))
        linking.resolve(banded.withColumn("used", F.array("key")))
    named = linking.named()
    keys = rows.select("doc_id", "key")
    own = keys.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    own = own.join(named, "key", "left").filter("n > 1 OR n_links > 0").select("key", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), "n_links", "linked_id", "similarity", F.lit(True).alias("shared"))
    # as a table of its own it leaves bare shuffles to the join, which Spark splits where one text has very many rows
    own = materialize(own, "shared")
    joined = keys.join(own, "key", "left")
    class_id = F.when(F.col("shared"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")
    out = materialize(joined.select("doc_id", "key", class_id, F.coalesce("class_key", "key").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "linked_id", "similarity"), "classes")
    drop_tables(features, sampled, named, own)
    release_shuffles(spark)
    return out


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, linked_id, similarity): one row per row of ``docs``; class_id is the least doc_id of its class.

    Equal texts are one class (empty ones too), and so are texts connected by links of 0.8 or more. A null text is a
    class of its own, whose class_id is its doc_id. Ids must be integers; rows with a null id get the class of their
    text, which is null if no other row has it. An id with several texts may be in several classes. Repeated rows stay; an empty
    table gives none; other columns play no part. n_links counts the links of a row's text among those that were needed to connect
    its class: a class of n different texts has at least n - 1. linked_id and similarity are those of the closest of them.
    """
    return _classes(docs, doc_id, text).select("doc_id", "class_id", "n_links", "linked_id", "similarity")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class: that of the least doc_id, of several texts of that id in the class the one of least md5; all columns stay.

    Rows that repeat both doc_id and text count once; rows with a null id stay only where no row of their class has one.
    The rows to be dropped are brought to the documents, by broadcast where they are few, else by shuffle.
    """
    each = _classes(docs).groupBy("doc_id", "key").agg(F.first("class_id").alias("class_id"), F.first("class_key").alias("class_key"), F.count("*").alias("n"))
    is_head = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("class_key"))
    marks = each.select(F.col("doc_id").alias("_folio_id"), F.col("key").alias("_folio_key"), is_head.alias("_folio_kept"), (F.col("n") > 1).alias("_folio_again"))
    gone = materialize(marks.filter("NOT _folio_kept OR _folio_again"), "dropped")
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("_folio_id")) & F.md5(docs["text"].cast("binary")).eqNullSafe(F.col("_folio_key"))
    near = F.broadcast if small_enough(gone, BROADCAST_TEXTS) else (lambda df: df)
    out = docs.join(near(gone), on, "left_anti")
    again = gone.filter("_folio_kept")
    if again.limit(1).count():
        out = out.unionByName(docs.join(near(again), on, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def report(docs: DataFrame) -> DataFrame:
    return classes(docs)
