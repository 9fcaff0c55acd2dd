"""What is due, what may be fetched, and how it goes: queues and metrics over tables, with the time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import age_days


def is_due(last_fetch: Column, status: Column, now: Column, ttl_days: int) -> Column:
    """Never fetched, failed, or fetched ``ttl_days`` whole days ago or more."""
    return (F.coalesce(status, F.lit("")) == "error") | F.coalesce(age_days(last_fetch, now) >= ttl_days, F.lit(True))


def too_soon(last_fetch: Column, now: Column, seconds: float) -> Column:
    return F.coalesce((F.unix_micros(now) - F.unix_micros(last_fetch)) / 1e6 < seconds, F.lit(False))


def crawl_queue(keys: DataFrame, records: DataFrame, now: Column, ttl_days: int, limit: int | None = 60, pages: DataFrame | None = None) -> DataFrame:
    """(key, score): due keys (key, score, file_order), best score first, the first ``limit`` of them."""
    if pages is not None:
        keys = keys.join(pages.select("key").distinct(), "key", "left_semi")
    due = keys.join(records.select("key", "last_fetch", "status"), "key", "left").filter(is_due(F.col("last_fetch"), F.col("status"), now, ttl_days))
    out = due.orderBy(F.desc("score"), "file_order").select("key", "score")
    return out if limit is None else out.limit(limit)


def rotation(queue: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next ``n`` of (key, pos) from ``cursor`` on, going round."""
    total = F.broadcast(queue.agg(F.count("*").alias("total")))  # one row
    return queue.crossJoin(total).orderBy(F.pmod(F.col("pos") - cursor, F.col("total"))).limit(n).select("key", "pos")


def rolling_count(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """Add ``n_hour``: requests of the same key within the hour up to each (key, ts)."""
    w = W.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("n_hour", F.count("*").over(w))


def next_expiry(records: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """One row: seconds to the soonest expiry, from 1 to 3600; 1 if a time is missing."""
    left = F.coalesce(ttl_seconds - (F.unix_micros(now) - F.unix_micros("last_fetch")) / 1e6, F.lit(1.0))
    return records.agg(F.least(F.greatest(F.coalesce(F.min(left), F.lit(3600.0)), F.lit(1.0)), F.lit(3600.0)).alias("wait"))


def outcome_counts(log: DataFrame) -> DataFrame:
    """(source, outcome, n)."""
    return log.groupBy("source", "outcome").agg(F.count("*").alias("n"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(pct, per_minute, eta_s); null where nothing is done or no time has passed."""
    rate = done / F.nullif(seconds, F.lit(0))
    return F.struct((100.0 * done / F.nullif(total, F.lit(0))).alias("pct"), (60.0 * rate).alias("per_minute"), ((total - done) / F.nullif(rate, F.lit(0.0))).alias("eta_s"))


def catch_up(lanes: DataFrame, index_per_minute: Column, backlog: Column) -> DataFrame:
    """One row: net pages a minute of an index against the lanes (ppm, enabled, idle) that run, and seconds until it is even (null: never)."""
    crawl = F.coalesce(F.sum(F.when(F.col("enabled") & ~F.col("idle"), F.col("ppm"))), F.lit(0.0))
    out = lanes.agg(crawl.alias("crawl")).select((index_per_minute - F.col("crawl")).alias("net"))
    return out.select("net", F.when(F.col("net") > 0, backlog / F.col("net") * 60).alias("eta_s"))
