"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything in the ASCII range that is neither a digit nor a lower-case letter parts words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_local_scratch: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a session on a local master may go without the setting; it then gets a folder of its own.
    """
    global _local_scratch
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="folio-scratch-", dir="/tmp")
    return _local_scratch


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/folio-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later stages read the files, so that a lost executor costs no recomputation of what came before.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by :func:`new_path` through Hadoop's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`materialize` that nothing reads any more."""
    for df in frames:
        if path := vars(df).get("_folio_path"):
            drop_path(df.sparkSession, path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal id, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; it counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let a Python worker hold few texts at once; texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more.

    Its cleaner learns of them when the driver's JVM collects garbage, by itself only every half hour. Worth a call where
    large shuffles have just been replaced by a written table.
    """
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return memory that a Python worker has freed to the system; idle workers stay beside the JVM for a while."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
