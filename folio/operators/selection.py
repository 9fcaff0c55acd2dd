"""Exact percentiles by selection: counts by range, refined where the rank lies. No task holds more than a bounded part."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a round counts, and values that are few enough to be looked at one by one.
RANGES, FEW = 4096, 10_000


def value_at(values: DataFrame, rank: int) -> float:
    """The value of ``rank`` (from 0) among the finite doubles of (v), which must be more than ``rank``."""
    row = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi = row["n"], row["lo"], row["hi"]
    while n > FEW and lo < hi:
        values = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        half, width = lo / 2, hi / 2 - lo / 2  # halves, as the difference of two doubles may be none
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("v") / 2 - half) / width * RANGES)) if width > 0 else (F.col("v") > lo).cast("long")
        ranges = values.groupBy(place.alias("r")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("r").collect()  # RANGES rows
        for r in ranges:
            if rank < r["n"]:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            rank -= r["n"]
    if lo == hi:
        return lo
    return sorted(r["v"] for r in values.filter((F.col("v") >= lo) & (F.col("v") <= hi)).collect())[rank]  # FEW rows


def exact_percentile(values: DataFrame, p: float) -> float | None:
    """The percentile (0 to 1) of the non-null numbers of (v), interpolated between neighbours; None without any.

    NaN counts as greater than infinity, as it sorts.
    """
    v = values.select(F.col("v").cast("double").alias("v")).filter("v IS NOT NULL")
    end = F.lit(float("inf"))
    row = v.agg(F.count_if(F.col("v") == -end).alias("low"), F.count_if((F.col("v") > -end) & (F.col("v") < end)).alias("n"), F.count_if((F.col("v") == end) & ~F.isnan("v")).alias("high"), F.count("*").alias("all")).first()
    if not row["all"]:
        return None
    finite = v.filter((F.col("v") > -end) & (F.col("v") < end))
    place = p * (row["all"] - 1)

    def at(rank: int) -> float:
        if rank < row["low"]:
            return -math.inf
        if rank < row["low"] + row["n"]:
            return value_at(finite, rank - row["low"])
        return math.inf if rank < row["low"] + row["n"] + row["high"] else math.nan

    lower = math.floor(place)
    first = at(lower)
    if place == lower:
        return first
    inside = row["low"] <= lower and lower + 1 < row["low"] + row["n"]
    if inside:  # one more look finds the neighbour
        up = finite.agg(F.count_if(F.col("v") <= first).alias("n"), F.min(F.when(F.col("v") > first, F.col("v"))).alias("next")).first()
        second = first if lower + 1 - row["low"] < up["n"] else up["next"]
    else:
        second = at(lower + 1)
    return first if first == second else (lower + 1 - place) * first + (place - lower) * second
