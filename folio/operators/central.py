"""Entries under the central procedure: which they are, their groups, and the document links seeded for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import ascii_fold, auth_key, brand_root, eu_number, trimmed_fold
from folio.operators.entities import word_prefix_join


def is_central(cells: Column) -> Column:
    """Whether a cell names the central procedure; the decentralised one holds the same letters and does not count."""
    return F.exists(cells, lambda c: F.lower(ascii_fold(c)).contains("centralis") & ~F.lower(ascii_fold(c)).contains("decentralis"))


def holder_after_number(cells: Column) -> Column:
    """The trimmed cell after the first one that holds an EU number; empty without."""
    at = F.array_position(F.transform(cells, lambda c: F.coalesce(eu_number(c) != "", F.lit(False))), True)
    return F.when(at > 0, F.coalesce(F.trim(F.get(cells, at.cast("int"))), F.lit(""))).otherwise("")


def central_entries(rows: DataFrame) -> DataFrame:
    """(key, name, eu, holder) of rows (cells, file_order) with an EU number or the central procedure; a key's last row counts."""
    c = F.col("cells")
    eu = eu_number(F.array_join(c, "\t"))
    kept = rows.filter((F.size(c) >= 2) & (F.trim(c[0]) != "")).filter((eu != "") | is_central(c))
    one = kept.select(F.trim(c[0]).alias("key"), F.struct(F.trim(c[1]).alias("name"), eu.alias("eu"), holder_after_number(c).alias("holder")).alias("x"), "file_order")
    return one.groupBy("key").agg(F.max_by("x", "file_order").alias("x")).select("key", "x.*")


def unlinked_groups(entries: DataFrame, links: DataFrame) -> DataFrame:
    """(auth, key, name): the least key of each group of (key, name, eu) in which no member has a link (key, url)."""
    members = entries.select(auth_key(F.col("eu"), F.col("name")).alias("auth"), "key", "name")
    linked = members.join(links.filter("url <> ''").select("key").distinct(), "key", "left_semi").select("auth").distinct()
    return members.join(linked, "auth", "left_anti").groupBy("auth").agg(F.min_by(F.struct("key", "name"), "key").alias("x")).select("auth", "x.*")


def seed_links(entries: DataFrame, links: DataFrame, index: DataFrame) -> DataFrame:
    """(key, url): for one entry of each group without a link, the address of the brand in ``index`` (brand, url, ord) that it matches.

    A brand matches if it equals the entry's folded brand root, or one is the other's first words; equal ones come first. Of a
    brand that the index holds twice the row of least ord counts, of equal ones the least address.
    """
    index = index.groupBy("brand").agg(F.min(F.struct("ord", "url")).alias("x")).select("brand", "x.*")
    need = unlinked_groups(entries, links).select("key", trimmed_fold(brand_root(F.col("name"))).alias("brand"))
    found = word_prefix_join(need.select(F.col("brand").alias("name")).distinct(), index.select(F.col("brand").alias("name"), "ord"))
    return need.join(found, need["brand"] == found["l"]).join(index.select(F.col("brand").alias("r"), "url"), "r").select("key", "url")


def crawl_targets(entries: DataFrame, linked: DataFrame, rendered: DataFrame) -> DataFrame:
    """(key): entries (key, name, eu) whose group has a seeded member: one that is linked or rendered, and an entry."""
    members = entries.select(auth_key(F.col("eu"), F.col("name")).alias("auth"), "key")
    seeded = linked.select("key").union(rendered.select("key")).distinct()
    groups = members.join(seeded, "key", "left_semi").select("auth").distinct()
    return members.join(groups, "auth", "left_semi").select("key")


def archive_retries(records: DataFrame, links: DataFrame) -> DataFrame:
    """(key, url): links whose document had to come from an archive and is to be asked for again."""
    return links.join(records.filter("via_archive").select("key").distinct(), "key", "left_semi").select("key", "url")
