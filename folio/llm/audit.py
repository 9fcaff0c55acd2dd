"""Operator 13: what each filter removes in every order of applying the filters.

A document's failures are five bits. Which filter of an order meets it first stands in a table of 32 failure sets by 120
orders, made once; a task counts its documents by part, failure set and label, looks every set up for all orders and adds the
counts where the table says. Parts' rows from all tasks are then summed. Texts are read once; what is shuffled
afterwards is a digest and some numbers for each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop_tables, materialize

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
LEAST_WORDS = 200
SPECIAL = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes whose words are listed at once.
CHUNK = 1 << 20
#: Parts whose counts a task holds; more are handed on before the next batch.
PARTS = 256
_gap = re.compile(rb"[\x20\x09-\x0D]")

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def first_failures() -> np.ndarray:
    """[failure set, order]: the step (from 0) whose filter is the first to fail, or 5."""
    fails = (np.arange(1 << len(FILTERS))[:, None, None] >> np.array(ORDERS)[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), len(FILTERS))


def word_counts(data: bytes) -> tuple[int, int]:
    """Words of a text in bytes, and different ones; a part of it at a time."""
    n, seen, at = 0, set(), 0
    while at < len(data):
        gap = _gap.search(data, at + CHUNK)
        end = gap.start() if gap else len(data)
        part = data[at:end].split()  # at the same six characters
        n += len(part)
        seen.update(part)
        at = end
    return n, len(seen)


def failures(data: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    n, different = word_counts(data)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    points = len(data.translate(None, CONTINUATION))
    return (n < LEAST_WORDS) | (100 * different < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (len(data.translate(None, SPECIAL)) < len(data)) << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fails, digests = [], []
        for data in b.column(2).cast(pa.large_binary() if pa.types.is_large_string(b.column(2).type) else pa.binary()):
            data = data.as_py()
            fails.append(failures(data))
            digests.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "part": b.column(1), "fails": pa.array(fails, pa.int32()), "digest": pa.array(digests, pa.binary())})


class _Tally:
    """Documents of some parts by failure set: all, good and toxic ones."""

    def __init__(self):
        self.table, self.parts = first_failures(), {}
        self.count = np.zeros((3, 0, 32), np.int64)

    def add(self, b: pa.RecordBatch) -> None:
        names = b.column(0).dictionary_encode()
        known = [self.parts.setdefault(p, len(self.parts)) for p in names.dictionary.to_pylist()]
        place = np.array(known, np.int64)[names.indices.to_numpy(zero_copy_only=False)] * 32 + b.column(1).to_numpy(zero_copy_only=False)
        new = np.zeros((3, len(self.parts), 32), np.int64)
        new[:, : self.count.shape[1]] = self.count
        for i, chosen in enumerate((slice(None), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False))):
            new[i] += np.bincount(place[chosen], minlength=len(self.parts) * 32).reshape(-1, 32)
        self.count = new

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row (part, counts) for each part: the counts of all orders and steps, one after the other."""
        n, steps, orders = len(FILTERS), len(FILTERS) + 1, len(ORDERS)
        filters, cells = np.array(ORDERS), np.arange(orders) * steps + self.table
        sets = np.arange(32)
        for part, at in self.parts.items():
            # the weights are whole numbers far below 2**53
            every, good, toxic = (np.bincount(cells.ravel(), np.repeat(self.count[i, at], orders), orders * steps).astype(np.int64).reshape(orders, steps)[:, :n] for i in range(3))
            total = self.count[0, at]
            fails = np.array([total[sets >> f & 1 == 1].sum() for f in range(n)])
            only = np.array([total[1 << f] for f in range(n)])
            credit = np.bincount(filters.ravel(), every.ravel(), n).astype(np.int64)
            out = {"kept": total.sum() - every.cumsum(1), "removed": every, "redundant": fails[filters] - every, "unique_fails": only[filters], "good_lost": good, "toxic_lost": toxic, "shapley": credit[filters]}
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * (orders * n), pa.string()), "place": pa.array(np.arange(orders * n), pa.int32()), **{c: pa.array(out[c].ravel(), pa.int64()) for c in COUNTS}})


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for b in batches:
        if b.num_rows:
            tally.add(b)
        if len(tally.parts) > PARTS:
            yield from tally.rows()
            tally = _Tally()
    yield from tally.rows()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (``source``), order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is an empty one, a null source the part "". A document whose id is null fails E never, and is no other's
    smaller copy; rows that repeat an id are no copies of each other by it. Of repeated labels of an id any that is 1
    counts; documents without label, or with a null id, are neither good nor toxic. No documents give no rows. Further columns play no part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    facts = materialize(rows.mapInArrow(_facts, "doc_id long, part string, fails int, digest binary"), "facts")
    # only texts that several rows have; a text's rows are pre-aggregated where they lie. As a table of its own it leaves
    # both sides of the join bare shuffles, which Spark splits where one text has very many rows
    least = materialize(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least"), "copies")
    marked = facts.join(least, "digest", "left").select("doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("fails"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    labelled = marked.join(known, "doc_id", "left").select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")])
    sums = labelled.mapInArrow(_tallies, "part string, place int, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("part", "place").agg(*[F.sum(c).alias(c) for c in COUNTS])
    names = F.array(*[F.lit("".join(FILTERS[f] for f in order)) for order in ORDERS])
    steps = len(FILTERS)
    out = materialize(sums.select("part", names[F.floor(F.col("place") / steps).cast("int")].alias("filter_order"), (F.col("place") % steps + 1).cast("int").alias("step"), *COUNTS), "audit")
    drop_tables(facts, least)
    return out


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
  + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS m FROM w),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS g, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS x FROM labels GROUP BY doc_id),
n AS (SELECT part, m, count(*) AS n, sum(coalesce(g, 0)) AS g, sum(coalesce(x, 0)) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
b(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM b p, b q, b r, b s, b t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i-1]), 0)::INTEGER AS before FROM o, range(1, 6) AS r(i)),
c AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & bit > 0 AND m & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN x ELSE 0 END) AS toxic_lost FROM n, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM c"""
