"""Intermediate tables in the folder that the cluster shares: written once as Parquet, read again, deleted by name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on a local master may go without it and then gets a folder of its own."""
    global _local_folder
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="folio-stage-", dir="/tmp")
    return _local_folder


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/folio-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, so that what follows neither computes it twice nor again when an executor is lost."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folio_stage = path
    return out


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def unstage(*frames: DataFrame) -> None:
    """Delete the files behind frames of :func:`staged` that nothing reads any more."""
    for df in frames:
        if path := vars(df).get("_folio_stage"):
            fs, p = hadoop(df.sparkSession, path)
            fs.delete(p, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; it is counted no further."""
    return df.limit(rows + 1).count() <= rows
