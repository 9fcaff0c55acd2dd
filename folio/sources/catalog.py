"""Sources of a document catalog: tab-separated tables, score lists, manifests, malformed JSON, per-key overlays."""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import clean_substance, tokens
from folio.operators.entities import ordered_distinct_text
from folio.sources.quoted import has_files, quoted_records
from folio.sources.versions import StaleVersion, VersionedTable


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(cells, file_order): lines split at tabs, quotes being ordinary characters; a missing file has no lines.

    ``file_order`` ascends with a line's place in the file.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "cells array<string>, file_order long")
    reader = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "")
    lines = reader.schema("value string").csv(path)
    return lines.withColumn("file_order", F.monotonically_increasing_id()).select(F.split("value", "\t").alias("cells"), "file_order")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(key, name, file_order) in the file's order, duplicates kept; rows of two cells or more with a key."""
    rows = read_lines(spark, path).filter("size(cells) >= 2")
    return rows.select(F.trim(F.col("cells")[0]).alias("key"), F.trim(F.col("cells")[1]).alias("name"), "file_order").filter("key <> ''")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(key, name): the last row of a key wins; quotes are read as CSV has them."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "key string, name string")
    rows = spark.read.option("sep", "\t").option("encoding", "ISO-8859-1").option("quote", '"').option("escape", '"').schema("key string, name string").csv(path)
    rows = rows.withColumn("o", F.monotonically_increasing_id()).select(F.trim("key").alias("key"), F.trim("name").alias("name"), "o").filter("key <> '' AND name IS NOT NULL")
    return rows.groupBy("key").agg(F.max_by("name", "o").alias("name"))


def column_tokens(rows: DataFrame, key_cell: int, text_cell: int, keep: DataFrame | None = None) -> DataFrame:
    """(key, tokens): all tokens of a cell by key; short rows are skipped, ``keep`` (key) limits the keys."""
    got = rows.filter(F.size("cells") > max(key_cell, text_cell)).select(F.trim(F.col("cells")[key_cell]).alias("key"), tokens(F.col("cells")[text_cell]).alias("t"))
    if keep is not None:
        got = got.join(keep.select("key").distinct(), "key", "left_semi")
    return got.select("key", F.explode_outer("t").alias("t")).groupBy("key").agg(F.collect_set("t").alias("tokens"))


def composition(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """(key, n_links, tokens): distinct values of cell 7 and tokens of cell 3, for rows of eight cells or more."""
    got = rows.filter("size(cells) > 7").select(F.trim(F.col("cells")[0]).alias("key"), F.trim(F.col("cells")[7]).alias("link"), tokens(F.col("cells")[3]).alias("t")).join(keep.select("key").distinct(), "key", "left_semi")
    return got.groupBy("key").agg(F.count_distinct("link").alias("n_links"), F.array_distinct(F.flatten(F.collect_set("t"))).alias("tokens"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(key, html) of headed, tab-separated files whose quoted cells may hold line ends, read in byte ranges.

    Rows of fewer than two cells are skipped; a missing path has no rows. See :func:`quoted_records` for what a quote means.
    """
    if not has_files(spark, path):
        return spark.createDataFrame([], "key string, html string")
    rows = quoted_records(spark, path).filter("record > 0 AND size(cells) >= 2")
    return rows.select(F.trim(F.col("cells")[0]).alias("key"), F.col("cells")[1].alias("html"))


def frequency(spark: SparkSession, path: str) -> DataFrame:
    """(term, score) of a file of JSON lines; lines without either are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "term string, score double")
    return spark.read.schema("term string, score double").json(path).filter("term IS NOT NULL AND score IS NOT NULL")


MANIFEST = "map<string,struct<last_fetch:string,hash:string,status:string,http:int,ema_pdf:string,error:string>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a key of a JSON object of records; a missing, empty or invalid file has none."""
    empty = spark.createDataFrame([], "key string, last_fetch timestamp, hash string, status string, http int, ema_pdf string, error string")
    if not _exists(spark, path):
        return empty
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m"))
    rows = whole.filter("m IS NOT NULL").select(F.explode("m").alias("key", "r"))
    return rows.select("key", F.try_to_timestamp("r.last_fetch").alias("last_fetch"), *[F.col(f"r.{c}").alias(c) for c in ("hash", "status", "http", "ema_pdf", "error")])


def fetch_dates(records: DataFrame) -> DataFrame:
    """(key, asof): records with a valid time."""
    return records.filter("last_fetch IS NOT NULL").select("key", F.to_date("last_fetch").alias("asof"))


def run_on_objects(text: str) -> list[dict]:
    """The objects of the array under ``"data"``, commas between them or not, up to the first error."""
    at = text.find('"data"')
    at = text.find("[", at) if at >= 0 else -1
    out, decoder = [], json.JSONDecoder()
    if at < 0:
        return out
    at += 1
    while at < len(text):
        if text[at] in " \t\r\n,":
            at += 1
            continue
        if text[at] == "]":
            break
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        if isinstance(value, dict):
            out.append(value)
    return out


RUN_ON = "id string, type string, medicine_name string, document_url string, translations map<string,string>"


def run_on_json(files: DataFrame) -> DataFrame:
    """Typed records, with their order, of files (value) that hold a JSON array with missing commas; garbage has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["value"]:
                for n, o in enumerate(run_on_objects(text or "")):
                    tr = o.get("translations")
                    rows.append((n, *(None if o.get(k) is None else str(o[k]) for k in ("id", "type", "medicine_name", "document_url")), {str(k): str(v) for k, v in tr.items()} if isinstance(tr, dict) else {}))
            yield pd.DataFrame(rows, columns=["ord", "id", "type", "medicine_name", "document_url", "translations"])

    return files.select("value").mapInPandas(parse, f"ord long, {RUN_ON}")


@F.pandas_udf(T.StringType())
def _gunzip(content: pd.Series) -> pd.Series:
    # Spark evaluates this for every row, so that plain files come by as well
    return content.map(lambda b: gzip.decompress(bytes(b)).decode("utf-8", "replace") if b and bytes(b[:2]) == b"\x1f\x8b" else "")


#: Keys that a point lookup asks for at most.
LOOKUP_KEYS = 1000


def _empty_files(spark: SparkSession, path: str, lane: str, keys: list[str] | None) -> DataFrame:
    """Overlay files of zero bytes, which scans of file contents pass over; only names and times are listed, of ``keys`` only theirs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = p.getFileSystem(spark._jsc.hadoopConfiguration()), []
    if keys is None:
        listed = fs.listStatusIterator(p)
        files = iter(lambda: listed.next() if listed.hasNext() else None, None)
    else:
        files = iter([s for k in keys for end in (".html", ".html.gz") if fs.exists(one := spark._jvm.org.apache.hadoop.fs.Path(p, f"{k}{end}")) for s in (fs.getFileStatus(one),)])
    for f in files:
        if f.isFile() and f.getLen() == 0 and (m := re.fullmatch(r"(\d{8})\.html(\.gz)?", f.getPath().getName())):
            found.append((lane, m[1], f.getPath().toString(), f.getModificationTime()))
    df = spark.createDataFrame(found, "lane string, key string, path string, ms long")
    return df.select("lane", "key", "path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def overlays(spark: SparkSession, path: str, lane: str, keys: list[str] | None = None) -> DataFrame:
    """(lane, key, html, mtime, archived): the newest file of each eight-digit key; zero bytes are an empty payload.

    With ``keys``, at most LOOKUP_KEYS of them, no other key's file is opened; others than eight digits are in no file.
    """
    if keys is not None:
        keys = sorted({k for k in keys if re.fullmatch(r"\d{8}", k)})
        if len(keys) > LOOKUP_KEYS:
            raise ValueError(f"a lookup takes {LOOKUP_KEYS} keys at most; join the overlays for more")
    names = "*.html*" if keys is None else "{" + ",".join([*keys, "-"]) + "}.html*"
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    key = F.regexp_extract("path", r"/(\d{8})\.html(\.gz)?$", 1)
    rows = files.select(F.lit(lane).alias("lane"), key.alias("key"), "path", "modificationTime", "length", "content").filter("key <> ''")
    rows = rows.unionByName(_empty_files(spark, path, lane, keys))
    newest = rows.groupBy("lane", "key").agg(F.max_by(F.struct("path", "length", "content"), F.struct("modificationTime", "path")).alias("f"), F.max("modificationTime").alias("mtime"))
    html = F.when(F.col("f.length") == 0, F.lit("")).when(F.col("f.path").endswith(".gz"), _gunzip(F.col("f.content"))).otherwise(F.decode(F.col("f.content"), "UTF-8"))
    return newest.select("lane", "key", html.alias("html"), "mtime", (F.col("f.length") == 0).alias("archived"))


def merged(base: DataFrame, overlay: DataFrame, dates: DataFrame | None = None, base_date: Column | None = None) -> DataFrame:
    """(key, html, asof, archived) of baseline (key, html) and overlays (key, html).

    A non-empty overlay wins; an empty one over a non-empty baseline leaves the baseline, archived, with the baseline's
    date; an empty one over nothing drops the key.
    """
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    both = base.select("key", F.col("html").alias("b")).join(overlay.select("key", F.col("html").alias("o")), "key", "full")
    if dates is not None:
        both = both.join(dates.select("key", F.col("asof").cast("string").alias("d")), "key", "left")
    else:
        both = both.withColumn("d", F.lit(None).cast("string"))
    archived = F.col("o").isNotNull() & ~has(F.col("o")) & has(F.col("b"))
    return both.select(
        "key", F.when(has(F.col("o")), F.col("o")).when(has(F.col("b")), F.col("b")).alias("html"),
        F.when(archived | F.col("o").isNull(), base_date if base_date is not None else F.lit(None).cast("string")).otherwise(F.col("d")).alias("asof"), archived.alias("archived"),
    ).filter("html IS NOT NULL")


def present(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(key): non-empty baseline, with non-empty overlays, without empty ones."""
    full = F.length(F.trim(F.coalesce("html", F.lit("")))) > 0
    return base.filter(full).select("key").union(overlay.filter(full).select("key")).distinct().join(overlay.filter(~full).select("key"), "key", "left_anti")


def file_signature(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files at ``path``; of none if there are none."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime") if has_files(spark, path) else None
    if files is None:
        return ""
    # one number of all files: nothing is sorted or gathered, and no content is read
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['s']}"


def present_in_baseline(spark: SparkSession, path: str, snapshot: VersionedTable) -> DataFrame:
    """(key): the keys of a baseline file whose cell has text, read from ``snapshot`` as long as the files are the same.

    The first call, and the first after a file has changed, read the files and make a version of the snapshot; others read that alone.
    Of two callers at once one makes the version, and both get the keys.
    """
    signature = file_signature(spark, path)
    known = snapshot.current()
    if known is None or known.facts.get("files") != signature:
        keys = baseline(spark, path).filter(F.length(F.trim(F.coalesce("html", F.lit("")))) > 0).select("key").distinct()
        try:
            known = snapshot.replace(keys, known, {"files": signature})
        except StaleVersion:
            return present_in_baseline(spark, path, snapshot)
    return snapshot.read(known)


def search_substances(rows: DataFrame) -> DataFrame:
    """(key, text): an entry's active substances (cell 3 of rows whose cell 6 is SA), cleaned, each once in order of the file."""
    kept = rows.filter("size(cells) > 7").filter(F.trim(F.col("cells")[6]) == "SA")
    return ordered_distinct_text(kept.select(F.trim(F.col("cells")[0]).alias("key"), clean_substance(F.col("cells")[3]).alias("s"), "file_order"), "key", F.col("s"), "file_order")


def page_keys(files: DataFrame) -> DataFrame:
    """(key): what stands before the first hyphen of the file names in (path)."""
    return files.select(F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("-"), F.lit(1)).alias("key")).filter("key <> ''").distinct()


def document_links(records: DataFrame) -> DataFrame:
    """(key, url): records of a manifest that name a document."""
    return records.filter("ema_pdf IS NOT NULL AND ema_pdf <> ''").select("key", F.col("ema_pdf").alias("url"))


def first_lane(*lanes: DataFrame) -> DataFrame:
    """Overlays (lane, key, ...) of several lanes; of a key that more than one has, the first lane's."""
    rows = [d.withColumn("_lane", F.lit(i)) for i, d in enumerate(lanes)]
    every = reduce(DataFrame.unionByName, rows)
    least = every.groupBy("key").agg(F.min("_lane").alias("_lane"))
    return every.join(least, ["key", "_lane"], "left_semi").drop("_lane").filter(F.col("key").rlike(r"^\d{8}$"))


def vector_meta(payloads: DataFrame) -> DataFrame:
    """(key, model, dim, src_hash) of vector files (key, payload); what can't be read has none."""
    m = F.from_json("payload", "model string, dim int, src_hash string")
    return payloads.select("key", m.alias("m")).filter("m.model IS NOT NULL").select("key", "m.*")
