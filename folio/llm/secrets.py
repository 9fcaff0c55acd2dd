"""Operator 2: secret scans over a trigram index.

Each rule's pattern is turned into a Boolean query over the trigrams that every match must hold. The index
keeps, for the trigrams that any rule asks for, the documents that hold them (letters folded to lower case);
a rule's postings are intersected and united as its query says, and only what is left is read with the regular
expression. A pattern without mandatory trigrams reads every document.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import materialize, small_enough

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _parser

#: Strings that one part of a pattern may stand for before it counts as "anything".
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``value_group`` is the group that must have ``least`` characters (0: the whole match)."""

    kind: str
    pattern: str
    value_group: int = 0
    least: int = 0
    any_case: bool = False
    #: A pattern with the same matches of at least ``least`` characters, where runs are long; else ``pattern``.
    quick: str | None = None


#: The three rules that each scan reports, then those that the operator adds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, quick=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, quick=r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("basic_auth", r"https?://[A-Za-z0-9._-]+:[^\s:@/]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str, any_case: bool = True) -> list[frozenset[str]] | None:
    """The query as alternatives, each a set of trigrams that must all occur; None if some match may hold none.

    Trigrams are of lower-case text. Only what all matches share is asked for, so no match is lost.
    """

    def cross(a, b):
        return None if a is None or b is None or len(a) * len(b) > MAX_STRINGS else {x + y for x, y in itertools.product(a, b)}

    def grams(strings):
        return {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}

    def both(a, b):
        return {x | y for x, y in itertools.product(a, b)} if len(a) * len(b) <= MAX_STRINGS else min((a, b), key=len)

    def walk(nodes):
        """(exact strings or None, alternatives) of a sequence."""
        exact, needs, whole = {""}, {frozenset()}, True
        for op, arg in nodes:
            strings, inner = part(op, arg)
            joined = cross(exact, strings)
            if joined is None:  # what came before ends here
                needs, whole = both(both(needs, grams(exact)), inner), False
                exact = strings if strings is not None else {""}
            else:
                exact = joined
                needs = both(needs, inner)
        needs = both(needs, grams(exact))
        return (exact if whole else None), needs

    def part(op, arg):
        nothing = {frozenset()}
        if op is _c.LITERAL:
            return {chr(arg).lower()}, nothing
        if op is _c.IN and all(k is _c.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(v).lower() for _, v in arg}, nothing
        if op is _c.SUBPATTERN:
            return walk(arg[-1])
        if op is _c.BRANCH:
            each = [walk(x) for x in arg[1]]
            strings = None if any(e[0] is None for e in each) else set().union(*(e[0] for e in each))
            return (strings if strings is None or len(strings) <= MAX_STRINGS else None), set().union(*(e[1] for e in each))
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = arg
            strings, needs = walk(inner)
            if high == 1 and low == 0 and strings is not None:
                return strings | {""}, nothing
            if low == high and strings is not None and len(strings) ** low <= MAX_STRINGS:
                return {"".join(x) for x in itertools.product(strings, repeat=low)}, nothing
            return None, (needs if low else nothing)
        if op is _c.AT:
            return {""}, nothing
        return None, nothing

    _, needs = walk(list(_parser.parse(pattern)))
    return None if frozenset() in needs else sorted((n for n in needs if not any(m < n for m in needs)), key=sorted)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches, leftmost first, in code points; failing ones are dropped.

    The pieces between the matches and the matches themselves add up to the text, which gives the places.
    """
    exp = ("(?i)" if rule.any_case else "") + (rule.quick or rule.pattern)
    group = 0 if rule.quick else rule.value_group
    found = F.regexp_extract_all(text, F.lit(exp), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(exp), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, exp, -1), 1, F.size(found))
    each = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(value, F.length).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    place = lambda a, m: F.struct(
        (a["at"] + m["gap"] + m["own"]).alias("at"),
        F.when(m["value"] >= (0 if rule.quick else rule.least), F.concat(a["out"], F.array(F.struct((a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["own"]).alias("end"))))).otherwise(a["out"]).alias("out"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(exp), F.aggregate(each, start, place, lambda a: a["out"])).otherwise(none)


def posting_lists(keyed: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(trigram, doc_id, text_key): which documents hold which of the trigrams that the rules ask for."""
    low = F.lower(F.col(text))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return keyed.select("doc_id", "text_key", low.alias("low")).select("doc_id", "text_key", F.explode(held).alias("trigram"))


def candidates(spark: SparkSession, keyed: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """(doc_id, text_key, kinds): the documents whose postings satisfy the queries of the rules named in kinds."""
    asked = [(r.kind, n, sorted(need)) for r in rules if (query := trigram_query(r.pattern)) is not None for n, need in enumerate(query)]
    clauses = spark.createDataFrame([(kind, n, len(need), t) for kind, n, need in asked for t in need] or [("", 0, 1, "")], "kind string, clause int, size int, trigram string")
    lists = posting_lists(keyed, sorted({t for *_, need in asked for t in need}) or [""], text)
    # the clauses are as many as the rules have, whatever the input
    met = lists.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "text_key", "kind", "clause", "size").agg(F.count_distinct("trigram").alias("n")).filter("n = size")
    return met.groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds"))


#: Candidate documents whose ids are broadcast at most; more of them meet the documents by shuffle.
BROADCAST_CANDIDATES = 300_000


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array<struct<start, kind_order, kind, end>> of every rule, by start and then by rule.

    Offsets are code points, ends exclusive. A null text is read as empty and stays null; rows that are repeated
    are each scanned; an empty table gives none; all other columns pass through, but one called ``out`` is replaced.
    Texts are not shuffled: the ids of the candidates that the index yields, far fewer than the documents, are
    brought to them, by broadcast where their number is small.
    """
    spark, whole = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    id_, key, named_kinds, rest = (f"_folio_{x}" for x in ("id", "key", "kinds", "hash"))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))
    kinds = materialize(candidates(spark, keyed, rules).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("kinds").alias(named_kinds)), "candidates")
    if small_enough(kinds, BROADCAST_CANDIDATES):
        kinds = F.broadcast(kinds)
    joined = docs.withColumn(rest, F.xxhash64(whole)).join(kinds, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(rest) == F.col(key)), "left")
    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int>>")

    def named_spans(order: int, r: Rule) -> Column:
        return F.transform(spans_of(whole, r), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), F.lit(r.kind).alias("kind"), s["end"].alias("end")))

    found = []
    for order, r in enumerate(rules):
        named = named_spans(order, r)
        found.append(named if trigram_query(r.pattern) is None else F.when(F.array_contains(named_kinds, r.kind), named).otherwise(none))
    return joined.withColumn(out, F.sort_array(F.concat(*found))).drop(id_, key, named_kinds, rest)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, of the text replaced by ``mark``; texts without stay as they are.

    A null or empty text stays so; repeated rows stay; an empty table gives none; all other columns pass through,
    whatever their names.
    """
    whole, spans = F.col(text), "_folio_spans"
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
    )
    clean = F.aggregate(spans, zero, cut, lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.length(whole))))
    return scan(docs, rules, text=text, out=spans).withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(whole)).drop(spans)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind_order"] < len(BASE_RULES))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text")).select("doc_id", *(of(r.kind) for r in BASE_RULES), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in DuckDB: every rule reads every text."""
    parts = []
    for order, r in enumerate(RULES):
        exp = (("(?i)" if r.any_case else "") + (r.quick or r.pattern)).replace("'", "''")
        group = 0 if r.quick else r.value_group
        parts.append(
            f"SELECT doc_id, {order} AS k, '{r.kind}' AS kind, regexp_extract_all(t, '{exp}', 0) AS m, regexp_extract_all(t, '{exp}', {group}) AS v, "
            f"string_split_regex(t, '{exp}') AS p, {0 if r.quick else r.least} AS least FROM d WHERE regexp_matches(t, '{exp}')"
        )
    union = "\n  UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (
  {union}
), e AS (
  SELECT doc_id, k, kind, m, v, p, least, unnest(range(1, len(m) + 1)) AS i FROM f
), s AS (
  SELECT doc_id, k, kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
  FROM e WHERE length(v[i]) >= least
), g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, k) FILTER (k < {len(BASE_RULES)}) AS base,
    string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, k) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
