"""Tables in versions: immutable files, and one small pointer file a version that is put in place once and never replaced.

A table is dealt into buckets by its key. A version names the folder that each bucket lies in, so that a new version
writes the buckets it changes and points to the old folders of the others. Readers of an older version keep its files until
:meth:`VersionedTable.expire` lets them go.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.staging import hadoop

#: File systems whose rename or link is one step that never replaces a file.
EXCLUSIVE = ("file", "hdfs", "viewfs")


class StaleVersion(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


@dataclass(frozen=True)
class Version:
    number: int
    #: bucket -> folder below the table's
    buckets: dict[int, str]
    schema: str
    facts: dict[str, str] = field(default_factory=dict)


def put_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its whole content in one step; False if the name is taken. Stores that can't are refused."""
    fs, to = hadoop(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme not in EXCLUSIVE:
        raise ValueError(f"{scheme}: has no rename that leaves an existing file alone")
    jvm = spark._jvm
    aside = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    try:
        if scheme == "file":  # a local rename replaces, a link does not
            plain = lambda p: jvm.java.nio.file.Paths.get(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            jvm.java.nio.file.Files.createLink(plain(to), plain(aside))
            return True
        return bool(fs.rename(aside, to))  # refused by the name node if ``to`` exists
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        if fs.exists(aside):
            fs.delete(aside, False)


class VersionedTable:
    """A table below ``root``, dealt by ``key`` into ``buckets``."""

    def __init__(self, spark: SparkSession, root: str, key: str = "key", buckets: int = 64):
        self.spark, self.root, self.key, self.n = spark, root.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def _names(self, folder: str) -> list[tuple[str, int]]:
        fs, p = hadoop(self.spark, f"{self.root}/{folder}")
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def numbers(self) -> list[int]:
        """The versions that are kept, in order."""
        return sorted(int(n[:-5]) for n, _ in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> Version | None:
        """The newest version; None before the first."""
        known = self.numbers()
        return self.at(known[-1]) if known else None

    def at(self, number: int) -> Version:
        fs, p = hadoop(self.spark, f"{self.root}/versions/{number:010d}.json")
        if not fs.exists(p):
            raise ValueError(f"version {number} is not kept")
        stream = fs.open(p)
        try:
            v = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, {int(b): f for b, f in v["buckets"].items()}, v["schema"], v["facts"])

    def there(self, version: Version) -> set[int]:
        """Buckets of a version whose folder still exists."""
        fs, _ = hadoop(self.spark, self.root)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return {b for b, f in version.buckets.items() if fs.exists(path(f"{self.root}/{f}"))}

    def read(self, version: Version | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """A version's rows (the newest one's), all or those of some buckets; None before the first version."""
        version = version or self.current()
        if version is None:
            return None
        schema = T.StructType.fromJson(json.loads(version.schema))
        paths = [f"{self.root}/{f}" for b, f in sorted(version.buckets.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame) -> dict[int, str]:
        """Write rows as new files of their buckets; they count once a version names them. Returns the folders."""
        made = f"data/{uuid.uuid4().hex}"
        # large buckets are split over tasks, small ones share one
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{made}")
        return {int(n.split("=")[1]): f"{made}/{n}" for n, _ in self._names(made) if n.startswith("_bucket=")}

    def commit(self, base: Version | None, buckets: dict[int, str], schema: T.StructType, facts: dict[str, str] | None = None) -> Version:
        """Make a version after ``base`` (None: the first one); StaleVersion if there is one already, or was before it expired."""
        if self.numbers()[-1:] != ([base.number] if base else []):
            raise StaleVersion(f"version {base.number if base else 0} is no longer the newest")
        new = Version((base.number if base else 0) + 1, buckets, json.dumps(schema.jsonValue()), facts or {})
        content = json.dumps({"buckets": new.buckets, "schema": new.schema, "facts": new.facts})
        hadoop(self.spark, self.root)[0].mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions"))
        if not put_once(self.spark, f"{self.root}/versions/{new.number:010d}.json", content):
            raise StaleVersion(f"version {new.number} exists")
        return new

    def replace(self, rows: DataFrame, base: Version | None, facts: dict[str, str] | None = None) -> Version:
        """Make ``rows`` the whole table, as the version after ``base``."""
        return self.commit(base, self.write(rows), rows.schema, facts)

    def expire(self, keep: int = 3, grace_s: float = 86_400) -> int:
        """Drop all but the last ``keep`` versions, and folders that no kept one names; returns how many folders went.

        Folders younger than ``grace_s`` stay: they may be of a writer that is about to commit, or of a reader still at work.
        """
        known = self.numbers()
        fs, _ = hadoop(self.spark, self.root)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        named = {f for n in known[-keep:] for f in self.at(n).buckets.values()}
        for n in known[:-keep]:
            fs.delete(path(f"{self.root}/versions/{n:010d}.json"), False)
        gone, before = 0, (time.time() - grace_s) * 1000
        for made, at in self._names("data"):
            if at > before:
                continue
            for b, _ in self._names(f"data/{made}"):
                if b.startswith("_bucket=") and f"data/{made}/{b}" not in named:
                    gone += bool(fs.delete(path(f"{self.root}/data/{made}/{b}"), True))
            if not any(b.startswith("_bucket=") for b, _ in self._names(f"data/{made}")):
                fs.delete(path(f"{self.root}/data/{made}"), True)
        return gone
