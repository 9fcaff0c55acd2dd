"""Operator 8: repeated substrings from an enhanced suffix array.

Every window of LEAST bytes is dealt by its minimizer, the least hash among its GRAM-byte strings, which is the same
for equal windows wherever they stand. Neighbouring windows with one minimizer travel together as a *fragment*.
Fragments whose minimizer stands at one place only hold nothing repeated; equal fragments are merged before they are shuffled.
What is left is sorted, bucket by bucket: the suffixes that begin at repeated windows, with their common prefixes. A
scan with a stack walks the tree of common-prefix intervals; an interval whose occurrences are preceded by
different bytes is a maximal repeat, and comes out with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop_tables, materialize, release_shuffles, small_batches
from folio.llm.neardup import mix

LEAST, GRAM = 200, 32
#: Windows in a fragment at most; a longer run of one minimizer is cut.
RUN = 512
#: Distinct fragments of one minimizer from which windows that occur once are dropped before they meet in one task.
HOT = 4000
#: Bytes that a task sorts at a time, unless one minimizer has more.
CHUNK = 4_000_000

_B = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


def rolling(b: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each string of ``size`` bytes, by doubling; empty if there is none."""
    if len(b) < size:
        return np.empty(0, np.uint64)
    have = {1: b.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= size:
        h = have[n]
        have[2 * n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    out, done = have[n], n
    for part in sorted(have, reverse=True):
        while size - done >= part:
            h = have[part]
            count = len(b) - done - part + 1
            out = out[:count] * _power(part) + h[done : done + count]
            done += part
    return out


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    n = 1
    m = h
    while 2 * n <= size:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    rest = size - n
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def fragments(data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fragments of a text of any length, found in blocks of so many windows; what a window belongs to is up to its bytes alone."""
    if len(data) < block + LEAST:
        return _fragments(data)
    parts = [(lo, _fragments(data[lo : lo + block + LEAST - 1])) for lo in range(0, len(data) - LEAST + 1, block)]
    return tuple(np.concatenate([p[i] + lo if i == 1 else p[i] for lo, p in parts]) for i in range(4))


def _fragments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, twice) of the fragments of a text, in order; none below LEAST bytes.

    ``twice``: the minimizer stands at several places of the text, so that a fragment may repeat within itself.
    """
    b = np.frombuffer(data, np.uint8)
    if len(b) < LEAST:
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(bool)
    reach = LEAST - GRAM + 1
    h = mix(rolling(b, GRAM))
    m = sliding_min(h, reach)
    # a place is some window's minimum if the greatest minimum around it is its own hash
    pad = np.full(reach - 1, np.uint64((1 << 64) - 1))
    places = h[h == ~sliding_min(np.concatenate((pad, ~m, pad)), reach)]
    values, counts = np.unique(places, return_counts=True)
    cuts = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]))
    if (np.diff(cuts) > RUN).any():
        cuts = np.unique(np.concatenate([np.arange(lo, hi, RUN) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)] + [cuts[-1:]]))
    keys = m[cuts[:-1]]
    return keys.view(np.int64), cuts[:-1], np.diff(cuts), np.isin(keys, values[counts > 1])


def suffix_array(symbols: np.ndarray, run_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the places by their suffix, common prefix with the one before it), in symbols.

    ``symbols`` holds integers; the suffix at a place goes up to its run_end. Ranks are doubled.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [rank], 1
    longest = int((run_end - np.arange(n)).max(initial=0))
    while step < longest:
        to = np.arange(n) + step
        after = np.where(to < run_end, rank[np.minimum(to, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    if n > 1:
        got = np.zeros(n - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            r, size = levels[level], 1 << level
            at_i, at_j = i + got, j + got
            fits = (at_i + size <= run_end[i]) & (at_j + size <= run_end[j])
            same = fits & (r[np.minimum(at_i, n - 1)] == r[np.minimum(at_j, n - 1)])
            got[same] += size
        lcp[1:] = got
    return order, lcp


def maximal_intervals(lcp: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, length): intervals of the suffix array with a common prefix of ``length`` > 0 and unlike left neighbours.

    ``left`` holds the symbol before each suffix in order of the array, negative and distinct where there is none.
    """
    changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    n = len(lcp)
    stack: list[tuple[int, int]] = []  # (length, first)
    values = lcp.tolist()
    for k in range(1, n + 1):
        v = values[k] if k < n else 0
        first = k - 1
        while stack and stack[-1][0] > v:
            length, first = stack.pop()
            if changes[k - 1] != changes[first]:
                yield first, k - 1, length
        if v and (not stack or stack[-1][0] < v):
            stack.append((v, first))


def repeats(contents: list[bytes], windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(fragment numbers, offsets, bytes) of each maximal repeat of LEAST bytes or more among fragments."""
    buf = np.frombuffer(b"".join(contents), np.uint8)
    size = windows + LEAST - 1
    begin = np.cumsum(size) - size
    own = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    pos = begin[own] + offset
    key = rolling(buf, LEAST)[pos]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return
    view = np.lib.stride_tricks.sliding_window_view(buf, LEAST)

    def unlike() -> list[np.ndarray]:
        """Windows that share the hash of the first of their class, but not its bytes."""
        first = np.unique(inverse[at], return_index=True)
        heads = at[first[1][np.searchsorted(first[0], inverse[at])]]
        parts = [slice(lo, lo + 20_000) for lo in range(0, len(at), 20_000)]
        return [at[p][(view[pos[at[p]]] != view[pos[heads[p]]]).any(1)] for p in parts]

    if len(odd := np.concatenate(unlike())):
        exact: dict[bytes, int] = {}
        for i in at[np.isin(inverse[at], inverse[odd])].tolist():  # those classes are made anew, by their bytes
            inverse[i] = exact.setdefault(view[pos[i]].tobytes(), len(counts) + len(exact))
        at = np.flatnonzero(np.bincount(inverse)[inverse] > 1)
        if not len(at):
            return
    # the windows themselves, in order: their bytes decide, the hash only left out those that occur once
    heads = np.unique(inverse[at], return_index=True)[1]
    texts = np.ascontiguousarray(view[pos[at[heads]]]).view(f"V{LEAST}").ravel()
    order = np.argsort(texts.view(f"S{LEAST}"), kind="stable") if not (buf == 0).any() else np.array(sorted(range(len(texts)), key=lambda i: texts[i].tobytes()), np.int64)
    rank = np.empty(len(heads), np.int64)
    rank[order] = np.arange(len(heads))
    symbol = rank[np.searchsorted(inverse[at[heads]], inverse[at])]
    # a suffix goes on as long as its windows follow each other within a fragment
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(own[at]) != 0)) + 1
    bounds = np.concatenate((breaks, [len(at)]))
    run_end = bounds[np.searchsorted(bounds, np.arange(len(at)), "right")]
    sa, lcp = suffix_array(symbol, run_end)
    where = pos[at[sa]]
    left = np.where(offset[at[sa]] > 0, buf[np.maximum(where - 1, 0)].astype(np.int64), -1 - np.arange(len(sa)))
    for first, last, n in maximal_intervals(lcp, left):
        got = at[sa[first : last + 1]]
        yield own[got], offset[got], n + LEAST - 1


def _cover(contents: list[bytes], windows: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each fragment the (start, end) stretches that repeats cover; one that occurs several times is covered whole."""
    size = windows + LEAST - 1
    begin = np.cumsum(size) - size
    reach = np.zeros(int(size.sum()) + 1, np.int64)
    for own, offset, n in repeats(contents, windows):
        at = begin[own] + offset
        reach[at] = np.maximum(reach[at], n)
    reach[begin[counts > 1]] = size[counts > 1]
    out: list[list[tuple[int, int]]] = []
    for lo, n in zip(begin.tolist(), size.tolist(), strict=True):
        at = np.flatnonzero(reach[lo : lo + n])
        out.append(_union(at, at + reach[lo + at]) if len(at) else [])
    return out


def _union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    first = np.flatnonzero(new)
    return list(zip(s[first].tolist(), e[np.concatenate((first[1:] - 1, [len(s) - 1]))].tolist(), strict=True))


_STRETCHES = "array<struct<start:int,end:int>>"


def _finder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct fragments in order of their minimizer -> what repeats cover in each."""
    held: list[pd.DataFrame] = []

    def done(b: pd.DataFrame) -> pd.DataFrame:
        got = _cover(list(b["data"]), b["windows"].to_numpy(np.int64), b["n"].to_numpy(np.int64))
        base = b["base"].to_numpy(np.int64).tolist()
        return pd.DataFrame([(c, [{"start": s + o, "end": e + o} for s, e in x]) for c, o, x in zip(b["content"], base, got, strict=True) if x], columns=["content", "stretches"])

    total = 0
    for b in batches:
        held.append(b)
        total += sum(map(len, b["data"]))
        if total >= CHUNK:
            both = pd.concat(held, ignore_index=True)
            same = (both["minimizer"] == both["minimizer"].iloc[-1]).to_numpy()
            cut = 0 if same.all() else len(both) - int(same[::-1].argmin())
            if cut:
                yield done(both.iloc[:cut])
            held = [both.iloc[cut:].reset_index(drop=True)]
            total = sum(map(len, held[0]["data"]))
    if held and sum(map(len, held)):
        yield done(pd.concat(held, ignore_index=True))


def _without_single_windows(contents: DataFrame) -> DataFrame:
    """Cut fragments of frequent minimizers down to windows that occur more than once."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, n, d in zip(b["content"], b["n"], b["data"], strict=True):
                h = rolling(np.frombuffer(d, np.uint8), LEAST).view(np.int64)
                yield pd.DataFrame({"content": c, "n": n, "at": np.arange(len(h), dtype=np.int32), "window": h})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                at = np.sort(np.asarray(r.places, np.int64))
                for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    out.append((r.minimizer, r.content, int(run[0]), r.n, len(run), r.data[run[0] : run[-1] + LEAST]))
            yield pd.DataFrame(out, columns=["minimizer", "content", "base", "n", "windows", "data"])

    each = contents.select("content", "n", "data").mapInPandas(hashes, "content binary, n long, at int, window long")
    often = each.groupBy("window").agg(F.sum("n").alias("k")).filter("k > 1").select("window")
    places = each.join(often, "window", "left_semi").groupBy("content").agg(F.collect_list("at").alias("places"))
    return contents.join(places, "content").select("minimizer", "content", "n", "data", "places").mapInPandas(cut, contents.schema)


def covered_stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, stretches): which bytes of each (doc_id, text, text_key) row are repeated; only rows that have some."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [fragments(t.encode()) for t in b["text"]]
            count = [len(p[0]) for p in parts]
            yield pd.DataFrame({"doc_id": b["doc_id"].repeat(count).array, "text_key": np.repeat(b["text_key"].to_numpy(), count), **{c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("minimizer", "first", "windows", "twice"))}})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                data = r.text.encode()
                for p in r.parts:
                    d = data[p["first"] : p["first"] + p["windows"] + LEAST - 1]
                    out.append((r.doc_id, r.text_key, p["first"], p["minimizer"], hashlib.blake2b(d, digest_size=16).digest(), p["windows"], d))
            frame = pd.DataFrame(out, columns=["doc_id", "text_key", "first", "minimizer", "content", "windows", "data"])
            frame["doc_id"] = pd.array(frame["doc_id"], dtype=b["doc_id"].dtype)
            yield frame

    kind = docs.schema["doc_id"].dataType.simpleString()
    long = docs.filter(F.octet_length("text") >= LEAST)
    pieces = materialize(long.mapInPandas(cut, f"doc_id {kind}, text_key long, minimizer long, first int, windows int, twice boolean"), "fragments")
    often = pieces.groupBy("minimizer").agg(F.count("*").alias("k"), F.max("twice").alias("twice")).filter("k > 1 OR twice").select("minimizer")
    by_row = pieces.join(often, "minimizer", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "minimizer", "windows")).alias("parts"))
    joined = long.alias("t").join(by_row.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.text_key") == F.col("p.text_key"))).select("t.doc_id", "t.text_key", "text", "parts")
    placed = materialize(joined.mapInPandas(fill, f"doc_id {kind}, text_key long, first int, minimizer long, content binary, windows int, data binary"), "placed")
    drop_tables(pieces)
    release_shuffles(spark)
    contents = placed.groupBy("minimizer", "content").agg(F.count("*").alias("n"), F.first("windows").alias("windows"), F.first("data").alias("data"))
    contents = materialize(contents.select("minimizer", "content", F.lit(0).alias("base"), "n", "windows", "data"), "contents")
    # from here on a fragment's place is all that is needed of its occurrences
    places = materialize(placed.select("doc_id", "text_key", "first", "content"), "places")
    drop_tables(placed)
    release_shuffles(spark)
    hot = contents.groupBy("minimizer").agg(F.count("*").alias("k")).filter(f"k > {HOT}").select("minimizer")
    if hot.limit(1).count():
        hot = materialize(hot, "hot")
        cool = contents.join(hot, "minimizer", "left_anti").select(*contents.columns)
        cut_down = materialize(cool.unionByName(_without_single_windows(contents.join(hot, "minimizer", "left_semi").select(*contents.columns))), "contents")
        drop_tables(contents, hot)
        contents = cut_down
    # every minimizer in one task, in order; its fragments are distinct
    sorted_ = contents.repartition("minimizer").sortWithinPartitions("minimizer")
    found = materialize(sorted_.mapInPandas(_finder, f"content binary, stretches {_STRETCHES}"), "stretches")
    shift = F.transform("stretches", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))
    drop_tables(contents)
    out = places.join(found, "content").select("doc_id", "text_key", shift.alias("x")).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("x")).alias("stretches"))
    out = materialize(out, "covered")
    drop_tables(places, found)
    release_shuffles(spark)
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the maximal repeated stretches of its UTF-8 bytes, and the bytes that stay.

    A byte goes if it lies in any string of LEAST bytes that also starts elsewhere in the table, in the same row too. A
    null or empty text has no bytes and keeps none; shorter texts than LEAST lose nothing. Rows that are repeated are
    occurrences of each other. ``spans`` (start, end) don't touch; ``kept`` is binary, as a cut may part a character.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    marked = covered_stretches(rows)
    joined = rows.join(marked, rows["doc_id"].eqNullSafe(marked["doc_id"]) & (rows["text_key"] == marked["text_key"]), "left").select(rows["doc_id"], "text", "stretches")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                data = r.text.encode()
                spans: list[tuple[int, int]] = []
                if r.stretches is not None and len(r.stretches):
                    spans = _union(np.array([s["start"] for s in r.stretches]), np.array([s["end"] for s in r.stretches]))
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True))
                out.append((r.doc_id, len(data), [{"start": s, "end": e} for s, e in spans], kept))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])
            frame["doc_id"] = pd.array(frame["doc_id"], dtype=b["doc_id"].dtype)
            yield frame

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInPandas(apply, f"doc_id {kind}, n_bytes long, spans {_STRETCHES}, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`remove_repeats`."""
    return remove_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
