"""Operator 4: URL rules, carried over redirects and canonical links.

A page's own rule decides where one fits. Where none does, the page takes part in a graph of addresses joined by
redirects (given ones, and a page's ``meta refresh``) and by canonical links; an explicit block anywhere in its
connected component blocks it, unless the component holds an explicit allow, which takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import UPPER, materialize, small_enough
from folio.llm.graph import components

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules that are broadcast at most; more of them are joined by shuffle.
BROADCAST_RULES = 50_000

RULE_SCHEMA = "rule_host string, rule_path string, verdict string"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def decide(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``ruled`` to distinct (host, path) rows: the longest rule that fits, or nulls.

    A host is looked up under itself and each of its parent domains, so that rules meet it by equality.
    Of equally long rules (the same rule given twice) a block wins over an allow.
    """
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    looked = places.filter("host <> ''").select("host", "path", F.explode(F.array_distinct(parents)).alias("rule_host"))
    few = small_enough(rules, BROADCAST_RULES)
    fits = looked.join(F.broadcast(rules) if few else rules, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), "verdict", F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))


def address(url: Column) -> Column:
    """The node of a url: without scheme (plain http redirects to https) and fragment, its host in lower case; else null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def link_targets(html: Column, url: Column) -> Column:
    """array<string>: absolute urls that a page names as its canonical address or refreshes to."""
    attr = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'\s>]+)""", 1)
    links = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), F.lit(0))
    metas = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), F.lit(0))
    named = F.concat(F.transform(links, lambda t: attr(t, "href")), F.transform(metas, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)""", 1)))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    absolute = lambda h: (
        F.when(h.contains("://"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), h))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(url), F.when(folder == "", F.lit("/")).otherwise(folder), h))
    )
    likely = html.rlike(r"""(?i)canonical|http-equiv\s*=\s*["']?refresh""")
    return F.when(likely, F.transform(F.filter(named, lambda h: h != ""), absolute)).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, by (rule, alias or default) of each row of ``pages`` (page_id, url, html).

    ``redirects`` may give (src, dst) urls. A null url, or one without ``://``, has an empty host and path, fits no
    rule, has no aliases and is allowed. Repeated rows are each judged; a null page_id stays null; null html has no
    links. Other columns play no part.
    """
    base = materialize(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node"), link_targets(F.col("html"), F.col("url")).alias("targets")), "pages")
    ruled = decide(base.select("host", "path").distinct(), rules)
    links = base.filter("size(targets) > 0").select("node", F.explode("targets").alias("t")).select(F.col("node").alias("src"), address(F.col("t")).alias("dst"))
    if redirects is not None:
        links = links.union(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    # addresses without links are their own component
    group = components(links)
    placed = base.select("page_id", "host", "path", "node").join(ruled, ["host", "path"], "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # decisions about addresses that are only linked to count as well
    linked = group.select("component", F.concat(F.lit("x://"), F.col("node")).alias("u")).select("component", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    said = linked.join(decide(linked.select("host", "path").distinct(), rules), ["host", "path"]).select("component", "ruled").union(placed.filter("component IS NOT NULL AND ruled IS NOT NULL").select("component", "ruled"))
    words = said.groupBy("component").agg(F.max((F.col("ruled") == "allow").cast("int")).alias("allowed"), F.max((F.col("ruled") == "block").cast("int")).alias("blocked"))
    blocked = words.filter("blocked = 1 AND allowed = 0").select("component", F.lit(True).alias("alias_blocked"))
    return placed.join(blocked, "component", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.when(F.col("ruled").isNotNull(), F.lit("rule")).when(F.col("alias_blocked"), F.lit("alias")).otherwise(F.lit("default")).alias("by"),
    )


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame([list(r) for r in rules], RULE_SCHEMA)


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, rule_table(spark)).drop("by")


#: Pages of the driver's tables hold no links, so each address stands for itself (its scheme and fragment aside).
SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT page_id, url, host, path, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS n
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.n = 1
"""
