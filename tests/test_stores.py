"""Quoted ranges, versioned tables and rebuilds."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import incremental
from folio.sources import catalog, quoted
from folio.sources.versions import StaleVersion, VersionedTable, put_once


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n_bytes, broadcast", [(23, True), (61, False), (10**9, True)])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_ranges_are_what_one_reader_reads(spark, tmp_path, ranges, monkeypatch, n_bytes, broadcast, end):
    ranges(n_bytes)
    if not broadcast:
        monkeypatch.setattr(quoted, "BROADCAST_RANGES", 0)
    rng, want = random.Random(n_bytes), set()
    for f in range(2):
        made = [["".join(rng.choice('ab"\n\t é') for _ in range(rng.choice([0, 1, 3, 8, 40, 150]))) for _ in range(rng.choice([1, 2, 3]))] for _ in range(12)]
        s = io.StringIO()
        csv.writer(s, delimiter="\t", lineterminator=end).writerows(made)
        text = s.getvalue() + 'x\tab"c\td\n"closed" after\t"a\n\n"\n' + ('"open for ever\n\nx' if f else "")
        (tmp_path / f"{f}.tsv").write_bytes(text.encode())
        want |= {(str(f), i, tuple(c)) for i, c in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter="\t"))}
    got = quoted.quoted_records(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", r"(\d)\.tsv", 1))
    assert {(r["file"], r["record"], tuple(r["cells"])) for r in got.collect()} == want


def test_baseline_in_ranges_equals_a_reader_of_whole_files(spark, tmp_path, ranges):
    text = "".join(f'{i}\t"page {i} ""x""\n{"line " * (i % 40)}\n"\n' for i in range(60))
    (tmp_path / "b.tsv").write_text("Code\tHtml\n" + text + "alone\n\t\n7\t\n")
    whole = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema("key string, html string").csv(str(tmp_path / "b.tsv"))
    want = rows(whole.filter("html IS NOT NULL")) + [("", ""), ("7", "")]
    ranges(197)
    assert rows(catalog.baseline(spark, str(tmp_path / "b.tsv"))) == sorted(want, key=str)
    assert catalog.baseline(spark, str(tmp_path / "none.tsv")).count() == 0
    (tmp_path / "empty.tsv").write_text("")
    assert catalog.baseline(spark, str(tmp_path / "empty.tsv")).count() == 0


def test_versions_are_never_replaced(spark, tmp_path):
    assert put_once(spark, str(tmp_path / "x"), "a") and not put_once(spark, str(tmp_path / "x"), "b") and (tmp_path / "x").read_text() == "a"
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    assert t.current() is None and t.read() is None
    df = lambda *r: spark.createDataFrame([(i, str(i)) for i in r], "key long, v string")
    one = t.replace(df(1, 2, 3), None)
    with pytest.raises(StaleVersion):
        t.replace(df(9), None)
    old = t.read(one)
    two = t.replace(df(4), one)
    with pytest.raises(StaleVersion):
        t.replace(df(9), one)  # the slower of two writers
    t.write(df(5))  # a crash before the commit
    assert rows(t.read()) == [(4, "4")] and rows(old) == [(1, "1"), (2, "2"), (3, "3")]
    assert t.expire(keep=1) == 0  # too young
    t.replace(df(), two)
    assert t.expire(keep=2, grace_s=-1) == len(one.buckets) + 3 and t.numbers() == [2, 3]  # and what never was committed
    assert rows(t.read(two)) == [(4, "4")] and t.read().count() == 0
    with pytest.raises(ValueError, match="not kept"):
        t.at(1)
    with pytest.raises(StaleVersion):  # also where the name that it would take is free again
        t.replace(df(9), None)


def test_rebuild_computes_only_what_changed(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=8)
    seen = spark.sparkContext.accumulator(0)

    def render(r):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return r.mapInArrow(count, r.schema).select("key", F.upper("text").alias("page"))

    def records(d):
        return incremental.hashes(spark.createDataFrame(list(d.items()), "key string, text string"), "text").join(spark.createDataFrame(list(d.items()), "key string, text string"), "key")

    def build(d, shared="a"):
        before = seen.value
        done = incremental.rebuild(t, records(d), render, shared)
        assert {r["key"]: r["page"] for r in t.read().collect()} == {k: v.upper() for k, v in d.items()}
        return seen.value - before, done.computed, done.reused, done.dropped, done.buckets

    d = {f"k{i}": f"text {i}" for i in range(40)}
    assert build(d) == (40, 40, 0, 0, 8)
    assert build(d) == (0, 0, 40, 0, 0)
    first = t.current().buckets
    changed = {k: v for k, v in d.items() if k != "k3"} | {"k5": "other", "new": "n"}
    n, computed, reused, dropped, buckets = build(changed)
    assert (n, computed, reused, dropped) == (2, 2, 38, 1) and 1 <= buckets <= 3
    assert sum(first[b] != f for b, f in t.current().buckets.items()) == buckets  # the others keep their files
    assert {r["made_in"] for r in t.read().filter("key IN ('k5', 'new')").collect()} == {3}
    assert build(changed, "b") == (40, 40, 0, 0, 8)
    lost = next(iter(t.current().buckets.values()))
    for f in (tmp_path / "t" / lost).iterdir():
        f.unlink()
    (tmp_path / "t" / lost).rmdir()
    n, computed, reused, dropped, buckets = build(changed, "b")
    assert n == computed > 0 and reused == 40 - n and buckets == 1
    assert build({}, "b") == (0, 0, 0, 40, 8)
    two = spark.createDataFrame([("a", "x", "h"), ("a", "y", "h")], "key string, text string, hash string")
    with pytest.raises(ValueError, match="own"):
        incremental.rebuild(t, two, render, "b")
    with pytest.raises(ValueError, match="own"):
        incremental.rebuild(t, spark.createDataFrame([(None, "x", "h")], two.schema), render, "b")


def test_global_key_ends_hits(spark):
    s = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string")
    t = spark.createDataFrame([("T", "slug")], "term string, slug string")
    key = lambda s, t, v="1": incremental.global_key(F.lit(v), F.lit("tpl"), s, t).first()["key"]
    base = key(s, t)
    assert base == key(s.orderBy(F.desc("key")).repartition(3), t.union(t))  # order and repeats play no part
    assert len({base, key(s, t, "2"), key(s.limit(1), t), key(s, t.limit(0))}) == 4


def test_a_lookup_opens_its_keys_files_alone(spark, tmp_path):
    for name, content in (("00000001.html", b"a"), ("00000002.html", b""), ("00000003.html", b"c"), ("00000003.html.gz", b""), ("00000004.html", b"d"), ("x.html", b"x")):
        (tmp_path / name).write_bytes(content)
    got = catalog.overlays(spark, str(tmp_path), "rcp", ["00000001", "00000002", "99999999", "x"])
    assert rows(got.select("key", "html", "archived")) == [("00000001", "a", False), ("00000002", "", True)]
    assert {p.rsplit("/", 1)[1] for p in got.inputFiles() if p.endswith(".html")} <= {"00000001.html", "00000002.html"}
    assert catalog.overlays(spark, str(tmp_path), "rcp", []).count() == 0 and catalog.overlays(spark, str(tmp_path), "rcp").count() == 4
    with pytest.raises(ValueError, match="at most"):
        catalog.overlays(spark, str(tmp_path), "rcp", [f"{i:08d}" for i in range(1001)])


def test_a_brand_twice_in_the_index_gives_one_link(spark):
    from folio.operators import central

    entries = spark.createDataFrame([("1", "Abilify 5 mg", "EU/1")], "key string, name string, eu string")
    index = spark.createDataFrame([("abilify", "u2", 1), ("abilify", "u1", 1), ("abilify", "u0", 2)], "brand string, url string, ord int")
    none = spark.createDataFrame([], "key string, url string")
    assert rows(central.seed_links(entries, none, index)) == [("1", "u1")]
