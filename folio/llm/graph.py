"""Connected components as DataFrame joins; nothing of the graph is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop_tables, materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst): the least node that it is connected with.

    Edges may be repeated, reversed or loops; null ends are left out. An empty graph gives no rows. Each round hangs all
    larger neighbours of a node below its least neighbour, then all smaller ones; a hub's edges are pre-aggregated
    where they lie before the shuffle, and its join is split where it is skewed. Rounds end when nothing moves.
    """
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    # stars point up: u > v
    e = materialize(e.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    count, mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if count == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the least of the neighbourhood
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "edges")
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        new = materialize(small, "edges")
        drop_tables(e, large)
        e, (count, now) = new, _mark(new)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    alone = loops.join(stars, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stars.union(alone)


def _mark(e: DataFrame) -> tuple[int, tuple]:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], (row["n"], row["s"])
