"""The overlay store by stream and by hand, stored presence, and sessions of a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folio.operators import lanes
from folio.sources import catalog
from folio.sources.versions import VersionedTable
from folio.streaming import overlays


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def at(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), buckets=8)


def batch(spark, *r):
    return spark.createDataFrame(list(r), overlays.SCHEMA)


def test_states_of_overlays(spark, table):
    base = spark.createDataFrame([("plain", "b"), ("live", "b"), ("delisted", "b"), ("blank", " "), ("back", "b")], "key string, html string")
    assert rows(overlays.states(table, base, F.lit("2022"))) == sorted([(k, "b", "2022", False) for k in ("plain", "live", "delisted", "back")])
    overlays.upsert(table, batch(spark, ("live", "o", at(2)), ("delisted", "", at(2)), ("blank", None, at(2)), ("gone", "", at(2)), ("new", "n", at(3)), ("back", "", at(2)), (None, "x", at(2)), ("live", "no time", None)))
    overlays.upsert(table, batch(spark, ("back", "again", at(4)), ("live", "late", at(1))))
    want = [("plain", "b", "2022", False), ("live", "o", "2024-01-02", False), ("delisted", "b", "2022", True), ("new", "n", "2024-01-03", False), ("back", "again", "2024-01-04", False)]
    assert rows(overlays.states(table, base, F.lit("2022"))) == sorted(want, key=str)
    assert overlays.compact(table, base) == 2  # "blank" and "gone" say nothing
    assert {r["key"] for r in overlays.overlays(table).collect()} == {"live", "delisted", "new", "back"}
    assert rows(overlays.states(table, base, F.lit("2022"))) == sorted(want, key=str) and overlays.compact(table, base) == 0


def test_a_repeated_batch_and_other_writers(spark, table, monkeypatch):
    assert overlays.upsert(table, batch(spark)) is None and overlays.overlays(table).count() == 0
    overlays.upsert(table, batch(spark, *[(str(i), "old", at(1)) for i in range(40)]), "a", 0)
    first = table.current()
    overlays.upsert(table, batch(spark, ("3", "new", at(2)), ("3", "older", at(1))), "a", 1)
    assert sum(first.buckets[b] != f for b, f in table.current().buckets.items()) == 1  # the others keep their files
    assert overlays.upsert(table, batch(spark, ("3", "never", at(9))), "a", 1) is None
    assert overlays.upsert(table, batch(spark, ("4", "b", at(2))), "b", 0).number == 3  # another source counts for itself
    real, todo = VersionedTable.commit, ["5", "6"]

    def commit(self, *a):
        if todo:
            key = todo.pop()
            overlays.upsert(VersionedTable(spark, table.root, buckets=8), batch(spark, (key, "between", at(3))))
        return real(self, *a)

    monkeypatch.setattr(VersionedTable, "commit", commit)
    overlays.upsert(table, batch(spark, ("5", "mine", at(2)), ("7", "mine", at(2))), "a", 2)
    got = {r["key"]: r["payload"] for r in overlays.overlays(table).collect()}
    assert len(got) == 40 and [got[k] for k in "34567"] == ["new", "b", "between", "between", "mine"] and not todo


def test_a_stream_of_batches(spark, table, tmp_path):
    parts = [[(str(i), "one", at(1)) for i in range(20)], [(str(i), "", at(2)) for i in range(0, 20, 2)], [("1", "three", at(3)), ("2", "late", at(1))]]
    for i, p in enumerate(parts):
        batch(spark, *p).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    apply = overlays.sink(table, "s", keep=2, grace_s=-1)
    stream = spark.readStream.schema(overlays.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    apply(batch(spark, *parts[2]), 2)
    got = {r["key"]: r["payload"] for r in overlays.overlays(table).collect()}
    assert got == {str(i): "three" if i == 1 else "" if i % 2 == 0 else "one" for i in range(20)}
    assert table.numbers() == [2, 3]
    named = {f.split("/")[1] for n in table.numbers() for f in table.at(n).buckets.values()}
    assert {p.name for p in (tmp_path / "t/data").iterdir() if p.is_dir()} == named  # what was superseded has gone


def test_presence_is_read_from_the_snapshot(spark, table, tmp_path, monkeypatch):
    path = tmp_path / "b.tsv"
    assert catalog.present_in_baseline(spark, str(path), table).count() == 0
    path.write_text('Code\tHtml\na\tx\nb\t" "\nc\t"y\nz"\n')
    assert rows(catalog.present_in_baseline(spark, str(path), table)) == [("a",), ("c",)]
    read = []
    monkeypatch.setattr(catalog, "baseline", lambda *a, real=catalog.baseline: read.append(a) or real(*a))
    assert rows(catalog.present_in_baseline(spark, str(path), table)) == [("a",), ("c",)] and not read
    path.write_text('Code\tHtml\na\tx\nd\tlonger than before\n')
    assert rows(catalog.present_in_baseline(spark, str(path), table)) == [("a",), ("d",)] and len(read) == 1


LOG = [("a", "user", "ok", 0), ("a", "auto", "error", 20), ("a", "crawl", "empty", 100), ("b", "user", "ok", 30), ("a", "user", "ok", 101), ("b", "odd", "odd", 300), (None, "user", "ok", 5), ("c", "user", "ok", None)]


def log(spark):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return spark.createDataFrame(LOG, "lane string, source string, outcome string, m int").withColumn("ts", F.when(F.col("m").isNotNull(), base + F.make_interval(mins="m"))).drop("m")


def test_totals_and_sessions_of_a_stream_are_the_batch(spark, tmp_path):
    df = log(spark)
    whole, stretches = rows(lanes.totals(df)), rows(lanes.sessions(df))
    assert [r[0] for r in stretches].count("a") == 2 and len(whole) == 4
    for split in (1, 3, len(LOG)):
        for i in range(split):
            spark.createDataFrame(df.collect()[i::split], df.schema).coalesce(1).write.parquet(str(tmp_path / f"{split}/in/{i}"))
        stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{split}/in/*"))  # noqa: B023, E731
        lanes.totals(stream()).writeStream.format("memory").queryName(f"totals{split}").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
        assert rows(spark.table(f"totals{split}")) == whole
        # the last stretches end when later rows say so; here a row far ahead does, which stays open itself
        end = spark.createDataFrame([("end", "user", "ok", dt.datetime(2025, 1, 1))], df.schema)
        end.write.parquet(str(tmp_path / f"{split}/in/z"))
        lanes.sessions(stream(), late="400 days").writeStream.format("memory").queryName(f"none{split}").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(f"none{split}").count() == 0  # nothing is given before it is sure
        lanes.sessions(stream(), late="10 hours").writeStream.format("memory").queryName(f"ended{split}").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert rows(spark.table(f"ended{split}")) == stretches
