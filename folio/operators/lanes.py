"""State of crawl and embedding lanes as tables: routing, forced passes, priorities, readiness and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.freshness import is_due


def lane_of(keys: DataFrame, central: DataFrame, names: tuple[str, str] = ("eu", "rcp")) -> DataFrame:
    """(key, lane): entries of the central procedure go to the first lane, all others to the second."""
    c = central.select("key").distinct().withColumn("_central", F.lit(True))
    return keys.select("key").join(c, "key", "left").select("key", F.when(F.col("_central"), names[0]).otherwise(names[1]).alias("lane"))


def pending_by_source(pending: DataFrame) -> DataFrame:
    """(source, n) of (key, source)."""
    return pending.groupBy("source").agg(F.count("*").alias("n"))


def lane_gauges(orders: DataFrame, records: DataFrame, forced: DataFrame, lanes: DataFrame, now: Column) -> DataFrame:
    """(lane, total, due, forced, eta_s) of each of ``lanes`` (lane, enabled, ttl_days, rate).

    ``orders`` (lane, key) is what a lane crawls, ``records`` (key, last_fetch, status) what is known, ``forced`` (lane, key)
    what a forced pass still has to fetch. A lane has as much to do as is due, or forced if that is more; nothing is due
    in one that is off. A page takes the lane's rate and half the jitter of up to ten seconds.
    """
    each = orders.join(records.select("key", "last_fetch", "status"), "key", "left").join(F.broadcast(lanes), "lane")
    due = F.count_if(F.col("enabled") & is_due(F.col("last_fetch"), F.col("status"), now, F.col("ttl_days")))
    got = each.groupBy("lane").agg(F.count("*").alias("total"), due.alias("ttl_due"))
    left = forced.groupBy("lane").agg(F.count("*").alias("forced"))
    out = lanes.select("lane", "rate").join(got, "lane", "left").join(left, "lane", "left").na.fill(0, ["total", "ttl_due", "forced"])
    n = F.greatest("ttl_due", "forced")
    return out.select("lane", "total", n.alias("due"), "forced", F.round(n * (F.col("rate") + F.least(F.col("rate"), F.lit(10.0)) / 2), 1).alias("eta_s"))


def forced_left(order: DataFrame, done: DataFrame) -> DataFrame:
    """(key, pos): what a forced pass over (key, pos) still has to fetch, whatever its age."""
    return order.join(done.select("key").distinct(), "key", "left_anti").select("key", "pos")


def priority_queue(arrivals: DataFrame, cap: int) -> DataFrame:
    """(key, source, at) of arrivals (key, source, at), in the order in which pages are embedded.

    A key counts once, by its first arrival. Pages of readers and crawls go to the front, the latest first; those of the
    sweep wait at the back in their order. The first ``cap`` arrivals fill the queue; beyond it only readers' pages come in.
    """
    first = arrivals.groupBy("key").agg(F.min_by(F.struct("source", "at"), F.struct("at", "source")).alias("x")).select("key", "x.*")
    within = first.orderBy("at", "key").limit(cap)  # the feature's own limit
    seen = within.union(first.filter("source = 'user'")).distinct()
    front = F.col("source").isin("user", "crawl")
    return seen.orderBy((~front).cast("int"), F.desc(F.when(front, F.col("at"))), F.when(~front, F.col("at")), "key")


def readiness(keys: DataFrame, overlays: DataFrame, rendered: DataFrame, fresh: DataFrame, pending: DataFrame, depth: int, cap: int, crawling: bool = True) -> DataFrame:
    """(key, status): what a reader who asks for a page's vectors is told.

    Without an overlay the page is crawled (or unavailable where nothing crawls); without a rendered page it is unavailable;
    with fresh vectors it is fresh; else queued. A reader's request goes past the cap, so that it is never busy.
    """
    mark = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    j = keys.select("key").distinct()
    for df, name in ((overlays, "_o"), (rendered, "_r"), (fresh, "_f"), (pending, "_p")):
        j = j.join(mark(df, name), "key", "left")
    status = (
        F.when(F.col("_o").isNull(), "crawling" if crawling else "unavailable").when(F.col("_r").isNull(), "unavailable").when(F.col("_f"), "fresh")
        .otherwise("queued")
    )
    return j.select("key", status.alias("status"), F.coalesce("_p", F.lit(False)).alias("pending"), F.lit(depth >= cap).alias("full"))


def totals(log: DataFrame) -> DataFrame:
    """(lane, ok, empty, error, user, auto, crawl, last): counters of (lane, source, outcome, ts); works on a stream too."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return log.groupBy("lane").agg(*(n("outcome", v) for v in ("ok", "empty", "error")), *(n("source", v) for v in ("user", "auto", "crawl")), F.max("ts").alias("last"))


def sessions(log: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """(lane, began, ended, ok, empty, error, user, auto, crawl): the counters of each stretch of a lane's work without a pause of ``gap``.

    A stream names with ``late`` how late its rows may come; a stretch is then given once it can't grow any more, and its state goes.
    Counts are combined before they are shuffled, so that one busy lane is no burden to a task.
    """
    rows = log.filter("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    got = (rows.withWatermark("ts", late) if late else rows).groupBy("lane", F.session_window("ts", gap).alias("w"))
    return got.agg(*(n("outcome", v) for v in ("ok", "empty", "error")), *(n("source", v) for v in ("user", "auto", "crawl"))).select("lane", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "ok", "empty", "error", "user", "auto", "crawl")


def embedding_order(keys: DataFrame, seed: int = 0) -> DataFrame:
    """(key, place): keys in a random order that a seed fixes, so that the time left is estimated from a fair sample."""
    return keys.select("key").withColumn("place", F.xxhash64(F.lit(seed), "key")).orderBy("place", "key")


def explicit_queue(asked: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, pos) of an explicit list (key, pos): each key once, where it came first."""
    out = asked.groupBy("key").agg(F.min("pos").alias("pos")).orderBy("pos")
    return out if limit is None else out.limit(limit)
