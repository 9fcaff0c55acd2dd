"""The store of overlays: payloads by key in versions, an empty payload being a mark of its own, fed by a stream.

A key has one of four states, with the baseline that the store lies over: its payload wins ("overlay"); an empty payload
over a baseline leaves the baseline, archived; an empty one over nothing drops the key; and keys without a
payload are the baseline's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources.catalog import merged
from folio.sources.versions import StaleVersion, Version, VersionedTable

SCHEMA = "key string, payload string, ts timestamp"


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by(F.struct("payload", "ts"), F.struct("ts", "payload")).alias("x")).select("key", "x.*")


def _rewrite(table: VersionedTable, base: Version | None, rows: DataFrame, touched: set[int], facts: dict[str, str]) -> Version:
    """A version in which ``rows`` are all of the buckets ``touched``; the others keep their files."""
    kept = {b: f for b, f in base.buckets.items() if b not in touched} if base else {}
    return table.commit(base, kept | table.write(rows), rows.schema, facts)


def upsert(table: VersionedTable, batch: DataFrame, source: str = "", batch_id: int | None = None) -> Version | None:
    """Bring a batch (key, payload, ts) in: of each key the newest payload stays, of equal times the greatest.

    A null payload is an empty one; null keys and times are left out. Only buckets with a key of the batch are written. A
    batch of a ``source`` whose ``batch_id`` the store has already seen changes nothing, so that a stream may repeat it. Other
    writers' commits in between are merged with. Returns the version made; None if there was none to make.
    """
    got = _newest(batch.filter("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.coalesce("payload", F.lit("")).alias("payload"), F.col("ts").cast("timestamp").alias("ts"))).persist()
    try:
        touched = {r[0] for r in got.select(table.bucket()).distinct().collect()}  # no more than there are buckets
        while True:
            base = table.current()
            facts = dict(base.facts) if base else {}
            if batch_id is not None and int(facts.get(f"seen {source}", -1)) >= batch_id:
                return None
            if batch_id is not None:
                facts[f"seen {source}"] = str(batch_id)
            if not touched and batch_id is None:
                return None
            old = table.read(base, touched & set(base.buckets)) if base else None
            rows = got if old is None else _newest(old.unionByName(got))
            try:
                return _rewrite(table, base, rows, touched, facts)
            except StaleVersion:  # merge with what the other writer has brought
                continue
    finally:
        got.unpersist()


def sink(table: VersionedTable, source: str, keep: int = 3, grace_s: float = 86_400) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: :func:`upsert`, then versions but the last ``keep`` go, and files older than ``grace_s`` that no kept one names."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert(table, batch, source, batch_id)
        table.expire(keep, grace_s)

    return apply


def overlays(table: VersionedTable, version: Version | None = None) -> DataFrame:
    """(key, payload, ts) of a version, empty payloads among them; no rows before the first."""
    found = table.read(version)
    return table.spark.createDataFrame([], SCHEMA) if found is None else found


def states(table: VersionedTable, base: DataFrame, base_date: Column | None = None) -> DataFrame:
    """(key, html, asof, archived) of the store over a baseline (key, html): see :func:`folio.sources.catalog.merged`."""
    over = overlays(table)
    return merged(base, over.select("key", F.col("payload").alias("html")), over.select("key", F.to_date("ts").alias("asof")), base_date)


def compact(table: VersionedTable, base: DataFrame) -> int:
    """Forget empty payloads of keys that the baseline (key, html) has no text for, where they say nothing; returns how many.

    Only buckets that hold some are written. StaleVersion if another writer commits meanwhile; nothing has changed then.
    """
    version = table.current()
    if version is None:
        return 0
    has = base.filter(F.length(F.trim(F.coalesce("html", F.lit("")))) > 0).select("key").distinct()
    rows = table.read(version)
    idle = rows.filter(F.length(F.trim("payload")) == 0).select("key").join(has, "key", "left_anti").persist()
    try:
        counts = {r["b"]: r["n"] for r in idle.groupBy(table.bucket().alias("b")).agg(F.count("*").alias("n")).collect()}
        if counts:
            _rewrite(table, version, table.read(version, set(counts)).join(idle, "key", "left_anti"), set(counts), version.facts)
        return sum(counts.values())
    finally:
        idle.unpersist()
