"""Incremental work by content hashes, and the outputs derived from a catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import ascii_fold, browse_letter, record_hash, search_fold, slug, sort_key
from folio.functions.vectors import pack
from folio.sources.versions import Version, VersionedTable
from folio.staging import staged, unstage


def plan(current: DataFrame, previous: DataFrame, same_version: bool = True) -> DataFrame:
    """(key, state) of (key, hash) tables: hit, changed, new or gone; with another version nothing is a hit."""
    c, p = current.select("key", F.col("hash").alias("h")), previous.select("key", F.col("hash").alias("old"))
    state = F.when(F.col("h").isNull(), "gone").when(F.col("old").isNull(), "new").when((F.col("h") == F.col("old")) & F.lit(same_version), "hit").otherwise("changed")
    return c.join(p, "key", "full").select("key", state.alias("state"))


def hashes(records: DataFrame, *fields: str) -> DataFrame:
    return records.select("key", record_hash(*map(F.col, fields)).alias("hash"))


def stale_vectors(pages: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """(key): pages (key, src_hash) whose vectors are missing, of other content, model or width; width 0 fits any."""
    fresh = (F.col("src_hash") == F.col("v_hash")) & (F.col("model") == model) & F.col("dim").isin(0, dim)
    v = vectors.select("key", F.col("src_hash").alias("v_hash"), "model", "dim")
    return pages.join(v, "key", "left").filter(~F.coalesce(fresh, F.lit(False))).select("key")


def search_index(entries: DataFrame, substances: DataFrame) -> DataFrame:
    """(key, name, slug, sub, line): ``sub`` only where the folded name does not hold it already; one JSON line each."""
    j = entries.join(substances.select("key", F.col("text").alias("s")), "key", "left")
    sub = F.when((F.coalesce("s", F.lit("")) != "") & ~F.contains(search_fold(F.col("name")), search_fold(F.col("s"))), F.col("s"))
    rows = j.select("key", "name", F.concat_ws("-", "key", slug(F.col("name"))).alias("slug"), sub.alias("sub"))
    return rows.withColumn("line", F.to_json(F.struct(F.col("key").alias("cis"), "name", "slug", "sub")))


def browse(entries: DataFrame) -> DataFrame:
    """(letter, n, keys): entries by letter in order of the folded name, then of the key."""
    rows = entries.select(browse_letter(F.col("name")).alias("letter"), sort_key(F.col("name")).alias("k"), "key")
    return rows.groupBy("letter").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "key"))), lambda x: x["key"]).alias("keys"))


def letter_counts(entries: DataFrame) -> DataFrame:
    """(letter, n, ord): letters in order, ``#`` last."""
    got = entries.groupBy(browse_letter(F.col("name")).alias("letter")).agg(F.count("*").alias("n"))
    return got.withColumn("ord", F.when(F.col("letter") == "#", F.lit(27)).otherwise(F.ascii("letter") - 64).cast("int"))


def sitemap(base: str, fixed: list[str], letters: DataFrame, pages: DataFrame) -> DataFrame:
    """(loc, lastmod): fixed pages, letters present, and pages (path, asof, full) that are full."""
    spark = pages.sparkSession
    none = F.lit(None).cast("string")
    f = spark.createDataFrame([(x,) for x in fixed], "path string").select("path", none.alias("lastmod"))
    ls = letters.select(F.concat(F.lit("/browse/"), F.when(F.col("letter") == "#", F.lit("num")).otherwise(F.lower("letter"))).alias("path"), none.alias("lastmod"))
    ps = pages.filter("full").select("path", F.nullif(F.split_part(F.coalesce("asof", F.lit("")), F.lit("T"), F.lit(1)), F.lit("")).alias("lastmod"))
    return f.union(ls).union(ps).select(F.concat(F.lit(base), "path").alias("loc"), "lastmod")


def prune(outputs: DataFrame, keep: DataFrame) -> DataFrame:
    """Outputs (slug, ...) whose slug is to be kept; the rest is what a snapshot leaves out."""
    return outputs.join(keep.select("slug").distinct(), "slug", "left_semi")


def fill(template: Column, **values: Column) -> Column:
    """A template with ``{{name}}`` places."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(v, F.lit("")))
    return template


def page_title(name: Column) -> Column:
    return ascii_fold(name)


def global_key(version: Column, template: Column, substances: DataFrame, terms: DataFrame) -> DataFrame:
    """One row (key): a hash that changes with the code's version, the template, any substance (key, text) or link term (term, slug).

    Each table is one number: the sum of its distinct rows' hashes, so that nothing is sorted or gathered.
    """
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.distinct().agg(F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias(name))

    both = digest(substances.select("key", "text"), "s").crossJoin(digest(terms.select("term", "slug"), "t"))  # one row each
    return both.select(record_hash(version, template, F.col("s"), F.col("t")).alias("key"))


def with_dates(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """``index`` (key, ...) with asof and full of the build manifest (key, asof, full); unknown pages have no date and are full."""
    m = manifest.groupBy("key").agg(F.max_by(F.struct("asof", "full"), "asof").alias("m"))
    return index.join(m, "key", "left").select(*[F.col(c) for c in index.columns], F.coalesce(F.col("m.asof"), F.lit("")).alias("asof"), F.coalesce(F.col("m.full"), F.lit(True)).alias("full"))


def search_rows(national: DataFrame, central: DataFrame, archived: DataFrame) -> DataFrame:
    """(key, name, slug, sub, eu, ret, line) in order of the key: both catalogs' rows (key, name, slug, sub), those of
    ``archived`` (key) marked as withdrawn; ``line`` is one JSON object without empty fields."""
    rows = national.withColumn("eu", F.lit(None).cast("int")).unionByName(central.withColumn("eu", F.lit(1)), allowMissingColumns=True)
    rows = rows.join(archived.select("key").distinct().withColumn("ret", F.lit(1)), "key", "left").select("key", "name", "slug", "sub", "eu", "ret")
    return rows.withColumn("line", F.to_json(F.struct(F.col("key").alias("cis"), "name", "slug", "sub", "eu", "ret"))).orderBy("key")


def only_overlays(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(key): keys that only an overlay has."""
    return overlay.select("key").distinct().join(base.select("key"), "key", "left_anti")


def payloads(chunks: DataFrame, model: str, prefix: str) -> DataFrame:
    """(key, dim, src_hash, payload): a page's vectors as JSON, of chunks (key, ord, sec, snippet, q, src_hash); q are int8 codes."""
    one = F.struct("ord", F.struct("sec", "snippet", pack(F.col("q")).alias("q")).alias("c"))
    pages = chunks.groupBy("key").agg(F.max(F.size("q")).alias("dim"), F.max("src_hash").alias("src_hash"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("chunks"))
    return pages.select("key", "dim", "src_hash", F.to_json(F.struct(F.lit(model).alias("model"), "dim", F.lit(prefix).alias("query_prefix"), "src_hash", "chunks")).alias("payload"))


@dataclass(frozen=True)
class Rebuilt:
    """What a rebuild did: the version made, rows computed, taken over and dropped, and buckets written anew."""

    version: Version
    computed: int
    reused: int
    dropped: int
    buckets: int


def rebuild(table: VersionedTable, records: DataFrame, render: Callable[[DataFrame], DataFrame], shared: str) -> Rebuilt:
    """Bring a table of outputs up to date with ``records`` (key, hash, ...), computing only what has changed.

    ``render`` makes output rows (key, ...) of records, one each. A record whose key and hash the newest version has keeps
    its output. Records that are new or have changed are rendered; outputs whose key has gone go. With another ``shared`` key (of
    code, templates and whatever else every output hangs on) nothing is kept. Only buckets with a difference are
    written; the new version points to the old files of the others. Outputs whose files were lost are rendered again. The columns
    hash and made_in, the version that computed a row, stand beside those of ``render``. A key that comes twice, or a null
    one, is an error. StaleVersion if another writer commits meanwhile; nothing has changed then.
    """
    base = table.current()
    number = (base.number if base else 0) + 1
    there = table.there(base) if base else set()
    now = records.select(F.col(table.key).alias("key"), F.col("hash").alias("h"))
    if base is not None and base.facts.get("shared") == shared and there:
        old = table.read(base, there).select(F.col(table.key).alias("key"), F.col("hash").alias("old"))
    else:  # nothing is a hit, and buckets left without rows fall away with the rest
        old, there = now.limit(0).select("key", F.col("h").alias("old")), set()
    now = now.groupBy("key").agg(F.count("*").alias("n"), F.first("h").alias("h"))
    state = F.when(F.col("n").isNull(), "gone").when(F.col("h") == F.col("old"), "hit").otherwise("miss")
    states = staged(now.join(old, "key", "full").select(F.col("key").alias(table.key), "n", state.alias("state")).withColumn("bucket", table.bucket()), "states")
    if wrong := states.filter(F.col(table.key).isNull() | (F.col("n") > 1)).limit(1).collect():
        raise ValueError(f"records must have a key of their own: {wrong[0][0]}")
    counts = {(r["bucket"], r["state"]): r["n_rows"] for r in states.groupBy("bucket", "state").agg(F.count("*").alias("n_rows")).collect()}  # three rows a bucket
    total = lambda s: sum(n for (_, state), n in counts.items() if state == s)
    touched = {b for b, s in counts if s != "hit"}
    made = render(records.join(states.filter("state = 'miss'").select(table.key), table.key, "left_semi"))
    hashed = made.join(records.select(table.key, "hash"), table.key) if "hash" not in made.columns else made
    rows = hashed.withColumn("made_in", F.lit(number))
    kept = there & touched
    if kept:
        hits = table.read(base, kept).join(states.filter("state = 'hit'").select(table.key), table.key, "left_semi")
        rows = hits.unionByName(rows)
    folders = {b: f for b, f in base.buckets.items() if b in there - touched} if base else {}
    new = table.commit(base, folders | (table.write(rows) if touched else {}), rows.schema, {"shared": shared})
    unstage(states)
    return Rebuilt(new, total("miss"), total("hit"), total("gone"), len(touched))


def fresh_by_time(pages: DataFrame, vectors: DataFrame, model: str, dim: int, first_pass: bool) -> DataFrame:
    """(key): pages (key, mtime) whose vectors (key, v_mtime, model, dim) are as new; model and width count on the first pass only."""
    j = pages.join(vectors, "key").filter("v_mtime >= mtime")
    return (j.filter((F.col("model") == model) & F.col("dim").isin(0, dim)) if first_pass else j).select("key")
