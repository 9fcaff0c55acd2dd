"""Separated files whose quoted cells may hold line ends, read in byte ranges.

A reader that starts in the middle of such a file can't tell whether it is inside quotes. Every range is therefore looked at
first for both answers: what a range makes of "outside" and of "inside" is a function of two states, and these functions,
composed in the file's order, say in which state each range begins. Then each range gives the records that begin and end in
it. A record that goes on in later ranges comes in pieces, at most two a range, which are put together by its number.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.staging import fits, hadoop, staged, unstage

#: Ranges whose states are broadcast at most, a row of some hundred bytes each; beyond it lines meet them by a shuffle.
BROADCAST_RANGES = 100_000

LOOKED_AT = "file string, block long, end0 int, end1 int, starts0 long, starts1 long, head string, head_ends boolean, tail0 string, tail1 string"


def state_after(line: str, inside: int, sep: str, quote: str) -> int:
    """1 if the line ends within quotes. A quote opens only as the first character of a cell, and closes unless doubled."""
    at = 0
    while True:
        if inside:
            while True:
                q = line.find(quote, at)
                if q < 0:
                    return 1
                if line[q + 1 : q + 2] != quote:
                    break
                at = q + 2
            next_cell = line.find(sep, q + 1)
            if next_cell < 0:
                return 0
            at, inside = next_cell + 1, 0
        if line.startswith(quote, at):
            at, inside = at + 1, 1
            continue
        opening = line.find(sep + quote, at)
        if opening < 0:
            return 0
        at, inside = opening + 2, 1


class _Range:
    """What a range looks like when it begins outside of quotes (0), and when inside (1)."""

    def __init__(self, file: str, block: int, sep: str, quote: str):
        self.file, self.block, self.sep, self.quote = file, block, sep, quote
        self.state, self.starts = [0, 1], [0, 0]
        #: lines of the record that is open, under each answer; of the one open from before, under "inside"
        self.open: list[list[str]] = [[], []]
        self.head: list[str] = []
        self.head_ends = False

    def add(self, line: str) -> None:
        plain = self.quote not in line
        for s in (0, 1):
            before = self.state[s]
            if not before:
                self.starts[s] += 1
            after = before if plain else state_after(line, before, self.sep, self.quote)
            if s and not self.starts[1]:
                self.head.append(line)
                self.head_ends = not after
            elif after:
                self.open[s].append(line)
            elif self.open[s]:
                self.open[s] = []
            self.state[s] = after

    def row(self) -> dict:
        text = lambda lines: "\n".join(lines) if lines else None
        return {"file": self.file, "block": self.block, "end0": self.state[0], "end1": self.state[1], "starts0": self.starts[0], "starts1": self.starts[1], "head": text(self.head), "head_ends": self.head_ends, "tail0": text(self.open[0]), "tail1": text(self.open[1])}


def _look(sep: str, quote: str):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("end0", pa.int32()), ("end1", pa.int32()), ("starts0", pa.int64()), ("starts1", pa.int64()), ("head", pa.string()), ("head_ends", pa.bool_()), ("tail0", pa.string()), ("tail1", pa.string())])
        at: _Range | None = None
        for b in batches:
            for line, file, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is None or (at.file, at.block) != (file, block):
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([at.row()], schema)
                    at = _Range(file, block, sep, quote)
                at.add(line)
        if at is not None:
            yield pa.RecordBatch.from_pylist([at.row()], schema)

    return look


def cells(record: str, sep: str, quote: str) -> list[str]:
    """A record's cells; a carriage return at its end is part of the line end."""
    csv.field_size_limit(1 << 31)
    return next(csv.reader([record.removesuffix("\r")], delimiter=sep, quotechar=quote), [])


def _records(sep: str, quote: str):
    """Whole records from a range's lines (value, file, block, inside, first)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, number, held, ours = None, 0, 0, [], False
        for b in batches:
            files, numbers, found = [], [], []
            for line, file, block, inside, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (file, block):
                    at, state, number, held, ours = (file, block), inside, first - 1, [], False
                if not state:
                    number, held, ours = number + 1, [], True
                state = state if quote not in line else state_after(line, state, sep, quote)
                if ours:  # else it began in an earlier range
                    held.append(line)
                    if not state:
                        files.append(file)
                        numbers.append(number)
                        found.append(cells("\n".join(held), sep, quote))
                        held = []
            yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string()), "record": pa.array(numbers, pa.int64()), "cells": pa.array(found, pa.list_(pa.string()))})

    return split


def _joined(sep: str, quote: str):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"file": b.column(0), "record": b.column(1), "cells": pa.array([cells(t, sep, quote) for t in b.column(2).to_pylist()], pa.list_(pa.string()))})

    return parse


def range_states(looked: DataFrame) -> DataFrame:
    """``looked`` with ``inside``, the state in which each range begins, and ``first``, the number of its first record.

    A range that ends in the same state whatever it began in is where the chain starts anew; since then, each range that
    swaps the states counts.
    """
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    fixed, swaps = F.col("end0") == F.col("end1"), (F.col("end0") > F.col("end1")).cast("int")
    counted = looked.withColumn("swaps", F.sum(swaps).over(W.partitionBy("file").orderBy("block")))
    last = F.last(F.when(fixed, F.struct("end0", "swaps")), ignorenulls=True).over(before)
    since = F.coalesce(F.sum(swaps).over(before), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    known = counted.withColumn("inside", F.pmod(F.coalesce(last["end0"], F.lit(0)) + since, F.lit(2)).cast("int")).drop("swaps")
    starts = F.when(F.col("inside") == 1, F.col("starts1")).otherwise(F.col("starts0"))
    return known.withColumn("first", F.coalesce(F.sum(starts).over(before), F.lit(0)).cast("long"))


def quoted_records(spark: SparkSession, path: str, sep: str = "\t", quote: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """(file, record, cells) of the files at ``path``; ``record`` counts a file's records from 0.

    Records end at a line feed outside of quotes, a carriage return before it is no part of them. A quote opens a quoted
    cell only as its first character, a doubled one inside stands for one, and one that is never closed takes the rest of the
    file; all as the standard library's reader has it. An empty line is a record without cells. An empty file has no
    records, a missing path is an error. Files are read in ranges of ``spark.sql.files.maxPartitionBytes``, compressed ones whole.
    """
    lines = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    looked = staged(lines.mapInArrow(_look(sep, quote), LOOKED_AT), "ranges")
    known = staged(range_states(looked), "states")
    states = known.select("file", "block", "inside", "first")
    if fits(states, BROADCAST_RANGES):
        placed = lines.join(F.broadcast(states), ["file", "block"])
    else:  # in the file's order again after the shuffle
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        placed = numbered.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line")
    whole = placed.select("value", "file", "block", "inside", "first").mapInArrow(_records(sep, quote), "file string, record long, cells array<string>")
    inside = F.col("inside") == 1
    end = F.when(inside, F.col("end1")).otherwise(F.col("end0"))
    starts = F.when(inside, F.col("starts1")).otherwise(F.col("starts0"))
    heads = known.filter(inside & F.col("head").isNotNull()).select("file", (F.col("first") - 1).alias("record"), "block", F.col("head").alias("text"))
    tails = known.filter((end == 1) & (starts > 0)).select("file", (F.col("first") + starts - 1).alias("record"), "block", F.when(inside, F.col("tail1")).otherwise(F.col("tail0")).alias("text"))
    # a record's pieces meet, and nothing else: they are as much as one record
    parts = heads.union(tails).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    joined = parts.select("file", "record", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")).mapInArrow(_joined(sep, quote), "file string, record long, cells array<string>")
    out = whole.union(joined)
    unstage(looked)
    return out


def has_files(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0
