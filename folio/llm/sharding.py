"""Operator 10: a shard store kept in order by size-tiered compaction.

Arrivals become small immutable runs. Runs are in tiers by their size, each tier ``fanout`` times as large as the one
before; as soon as a tier holds ``fanout`` runs they are merged into one run of target-sized files. Every change is a
new version of the manifest, which names the runs that are valid; a version is written aside and put in place in one
step that fails if another writer was first, so that readers see all of a change or nothing of it. The last versions
stay readable; data that none of them names is deleted.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folio.llm.common import drop_path, new_path, release_shuffles

#: Arrivals that one call commits one by one; a table with more values of its key has them grouped into so many.
MAX_ARRIVALS = 1000
#: After so many versions a merge also looks for folders that a crash has left.
ORPHANS_EVERY = 64


@dataclass(frozen=True)
class Run:
    """``parts`` are folders below the store's root; sizes are of the rows, not of their encoding."""

    name: str
    parts: tuple[str, ...]
    rows: int
    size: int
    arrivals: int
    #: of the columns as they are stored, in JSON
    schema: str = ""


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """``keep`` versions can be read; folders that no commit names are deleted ``grace`` seconds after they were written.

    Nulls, repeated rows and all columns are stored as they come; an arrival without rows is a run without rows.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = 4, target_bytes: int = 128 << 20, keep: int = 2, grace: float = 86_400):
        if fanout < 2 or keep < 1:
            raise ValueError("a merge needs two runs at least, and a store one version")
        self.keep, self.grace = keep, grace
        self.spark, self.root, self.fanout, self.target = spark, root.rstrip("/"), fanout, target_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifest

    def _manifest(self, version: int):
        return self._path(f"{self.root}/manifest/{version:08d}.json")

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        """The valid runs of a version, oldest first. There are at most fanout - 1 a tier once merges are done."""
        version = self.version() if version is None else version
        if not version:
            return []
        if not self._fs.exists(self._manifest(version)):
            raise ValueError(f"version {version} is not kept")
        stream = self._fs.open(self._manifest(version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r | {"parts": tuple(r["parts"])}) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], base: int) -> int:
        """Make ``runs`` version ``base + 1``; ConflictError if there is one, or was.

        Versions are forgotten in time, so that a free name alone says little: ``base`` must be the newest still.
        """
        if self.version() != base:
            raise ConflictError(f"version {base} is no longer the newest")
        to, aside = self._manifest(base + 1), self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"runs": [asdict(r) for r in runs]}).encode()))
        finally:
            out.close()
        if not self._put(aside, to):
            raise ConflictError(f"version {base + 1} exists")
        return base + 1

    def _put(self, aside, to) -> bool:
        """Give a finished file its name; False if the name is taken. Both ways are one step that never replaces a file."""
        jvm = self.spark._jvm
        try:
            if self._fs.getUri().getScheme() == "file":  # where a rename replaces, but a link does not
                path = lambda p: jvm.java.nio.file.Paths.get(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString(), self.spark.sparkContext._gateway.new_array(jvm.String, 0))
                jvm.java.nio.file.Files.createLink(path(to), path(aside))
                return True
            return bool(not self._fs.exists(to) and self._fs.rename(aside, to))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            if self._fs.exists(aside):
                self._fs.delete(aside, False)

    # runs

    def tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fanout) + 1e-9)

    def _write(self, rows: DataFrame, name: str, size: str, arrivals: int) -> Run:
        seen = Observation()
        part = f"data/{name}-{uuid.uuid4().hex[:8]}"
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.expr(size)).alias("size")).write.parquet(f"{self.root}/{part}")
        return Run(name, (part,), seen.get["rows"], int(seen.get["size"] or 0), arrivals, rows.schema.json())

    def _refuse_other_types(self, rows: DataFrame, runs: list[Run]) -> None:
        """ValueError if a column of ``rows`` has another type in some run."""
        new = {f.name: f.dataType for f in rows.schema}
        for schema in {r.schema for r in runs if r.schema}:
            for f in StructType.fromJson(json.loads(schema)):
                if f.name in new and new[f.name] != f.dataType:
                    raise ValueError(f"column {f.name} is {f.dataType.simpleString()} in the store, not {new[f.name].simpleString()}")

    def _commit_arrival(self, run: Run) -> int:
        """Commit a run that is written, after whatever other writers have committed meanwhile."""
        while True:
            base = self.version()
            try:
                return self.commit([*self.runs(base), replace(run, name=f"run-{base + 1:08d}")], base)
            except ConflictError:  # an arrival goes with any version
                continue

    def append(self, rows: DataFrame, size: str = "1", merge: bool = True) -> int:
        """Add an arrival as an immutable run and commit it; then merge what is due. ``size`` is SQL for a row's bytes.

        Runs may have different columns, of which a read fills those that a run lacks with nulls; a column of another type
        than in the store is a ValueError, and nothing is stored. Any other error means that the arrival isn't in either, unless the
        merge after it fails: other writers' commits are no error, an arrival goes in behind them and a merge is made anew.
        """
        base = self.version()
        self._refuse_other_types(rows, self.runs(base))
        version = self._commit_arrival(self._write(rows, f"run-{base + 1:08d}", size, 1))
        return self.compact() if merge else version

    def append_all(self, rows: DataFrame, key: str, keys: list, size: str = "1") -> int:
        """Add the arrivals of one table in the order of ``keys``, the values of ``key``: written together, committed one by one.

        Each arrival is written as ceil(its size / target) files, its rows dealt among them at random.
        """
        folder = f"data/arrivals-{uuid.uuid4().hex[:8]}"
        self._refuse_other_types(rows, self.runs())
        if not keys:
            return self.version()
        table = self.spark.createDataFrame([(k, i) for i, k in enumerate(keys)], StructType([StructField("_folio_key", rows.schema[key].dataType), StructField("_folio_arrival", IntegerType())]))
        placed = rows.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_folio_key"))).drop("_folio_key")
        sizes = {r["_folio_arrival"]: r for r in placed.groupBy("_folio_arrival").agg(F.count("*").alias("rows"), F.sum(F.expr(size)).alias("size")).collect()}
        files = self.spark.createDataFrame([(i, self._files(int(r["size"] or 0))) for i, r in sizes.items()], "_folio_arrival int, _folio_files int") if sizes else None
        if files is not None:
            # a row's file goes by its place in its task, so that repeated rows spread too
            dealt = placed.join(F.broadcast(files), "_folio_arrival").withColumn("_folio_file", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_folio_files"))).drop("_folio_files")
            dealt.repartition("_folio_arrival", "_folio_file").write.partitionBy("_folio_arrival", "_folio_file").parquet(f"{self.root}/{folder}")
            release_shuffles(self.spark)
        version = self.version()
        for i in range(len(keys)):
            if i in sizes:
                self._commit_arrival(Run("", (f"{folder}/_folio_arrival={i}",), sizes[i]["rows"], int(sizes[i]["size"] or 0), 1, rows.schema.json()))
                version = self.compact()
        return version

    def _files(self, size: int) -> int:
        return max(1, math.ceil(size / self.target))

    def due(self, runs: list[Run]) -> list[Run]:
        """The oldest ``fanout`` runs of the lowest tier that has so many."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(self.tier(r.size), []).append(r)
        return next((tiers[t][: self.fanout] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merge while any tier is full; each merge is one commit, after which what no kept version names goes.

        No file of a merged run has more rows than its size over the target asks for; nothing is shuffled.
        """
        while merge := self.due(runs := self.runs(base := self.version())):
            size, name = sum(r.size for r in merge), f"run-{base + 1:08d}"
            part = f"data/{name}-{uuid.uuid4().hex[:8]}"
            # as many tasks as files, each of which reads whole splits; a file that gets too long goes on in another
            files, count = self._files(size), sum(r.rows for r in merge)
            rows = self._read(merge)
            rows.coalesce(files).write.option("maxRecordsPerFile", max(1, math.ceil(count / files))).parquet(f"{self.root}/{part}")
            run = Run(name, (part,), sum(r.rows for r in merge), size, sum(r.arrivals for r in merge), rows.schema.json())
            gone = {r.name for r in merge}
            at = next(i for i, r in enumerate(runs) if r.name in gone)
            kept = [r for r in runs if r.name not in gone]
            try:
                version = self.commit([*kept[:at], run, *kept[at:]], base)
            except ConflictError:  # another writer was first: what is due may be something else now
                drop_path(self.spark, f"{self.root}/{part}")
                continue
            self.vacuum(merge)
            if version % ORPHANS_EVERY == 0:
                self.vacuum()
        return self.version()

    def vacuum(self, runs: list[Run] | None = None) -> None:
        """Forget versions older than the last ``keep``, and delete what no other names: of ``runs``, which were committed, at
        once; without ``runs`` any folder of the store, left by a crash or a failed commit, once it is older than ``grace``."""
        newest = self.version()
        oldest = max(1, newest - self.keep + 1)
        valid = {p for v in range(oldest, newest + 1) for r in self.runs(v) for p in r.parts}
        folder = self._path(f"{self.root}/manifest")
        gone = [s.getPath() for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit() and int(n[:-5]) < oldest] if newest else []
        lost: set[str] = set()
        if runs is None and self._fs.exists(data := self._path(f"{self.root}/data")):
            limit = self.spark._jvm.System.currentTimeMillis() - self.grace * 1000
            for s in self._fs.listStatus(data):
                if s.getModificationTime() <= limit and not any(f"{p}/".startswith(f"data/{s.getPath().getName()}/") for p in valid):
                    lost.add(f"data/{s.getPath().getName()}")
        else:
            # what the versions that end here held, and no kept one does
            named = {p for g in gone for r in self.runs(int(g.getName()[:-5])) for p in r.parts} | {p for r in runs or [] for p in r.parts}
            lost = named - valid
        for g in gone:
            self._fs.delete(g, False)
        for part in lost:
            drop_path(self.spark, f"{self.root}/{part}")

    def _read(self, runs: list[Run]) -> DataFrame:
        """The rows of runs; a column that some of them lack is null there."""
        read, by_schema = self.spark.read.option("recursiveFileLookup", "true"), {}
        for r in runs:
            by_schema.setdefault(r.schema, []).extend(f"{self.root}/{p}" for p in r.parts)
        frames = [(read.schema(StructType.fromJson(json.loads(x))) if x else read).parquet(*parts) for x, parts in by_schema.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def read(self, version: int | None = None, run: str = "run") -> DataFrame:
        """All rows of a version with the run that holds them (column ``run``); ValueError if the store is empty."""
        runs = self.runs(version)
        if not runs:
            raise ValueError("the store is empty")
        frames = [self._read([r]).withColumn(run, F.lit(r.name)) for r in runs]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shard(docs: DataFrame, arrival: str = "source", text: str = "text", fanout: int = 4, target_bytes: int = 128 << 20) -> DataFrame:
    """doc_id, arrival, n_bytes, run, tier, run_rows, run_bytes, version of every row: where the store holds it in the end.

    Each value of ``arrival``, null included, is an arrival, in ascending order (null first); of more than MAX_ARRIVALS
    values, those that share a hash are one. Every row is kept, repeated ones too; a null text has no bytes, nulls stay.
    An empty table makes no run and gives no rows. All columns of ``docs``, of whatever name and type, are stored.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, new_path(spark, "shards"), fanout, target_bytes)
    return _located(store, _fill(store, docs, arrival, text), docs, arrival)


def _fill(store: ShardStore, docs: DataFrame, arrival: str, text: str) -> int:
    rows = docs.withColumns({"_folio_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "_folio_batch": F.col(arrival)})
    few = lambda: [r["_folio_batch"] for r in rows.select("_folio_batch").distinct().orderBy("_folio_batch").limit(MAX_ARRIVALS + 1).collect()]
    keys = few()
    if len(keys) > MAX_ARRIVALS:
        rows = rows.withColumn("_folio_batch", F.pmod(F.xxhash64("_folio_batch"), F.lit(MAX_ARRIVALS)))
        keys = few()
    return store.append_all(rows, "_folio_batch", keys, "_folio_bytes")


def _located(store: ShardStore, version: int, docs: DataFrame, arrival: str) -> DataFrame:
    spark = docs.sparkSession
    if not version:
        none = docs.select("doc_id", F.col(arrival).alias("arrival")).limit(0)
        return none.select("doc_id", "arrival", F.lit(0).cast("long").alias("n_bytes"), F.lit("").alias("run"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("run_rows"), F.lit(0).cast("long").alias("run_bytes"), F.lit(0).alias("version"))
    held = spark.createDataFrame([(r.name, store.tier(r.size), r.rows, r.size) for r in store.runs()], "run string, tier int, run_rows long, run_bytes long")
    rows = store.read(run="_folio_run").select("doc_id", F.col(arrival).alias("arrival"), F.col("_folio_bytes").alias("n_bytes"), F.col("_folio_run").alias("run"))
    return rows.join(F.broadcast(held), "run").select("doc_id", "arrival", "n_bytes", "run", "tier", "run_rows", "run_bytes", F.lit(version).alias("version"))
