"""Fuzzy words, exact percentiles and page ranking against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import entities, fuzzy, retrieval, selection


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def credit(t, w):
    if t == w:
        return 1.0
    if len(t) >= 4 and len(w) >= 4 and (t.startswith(w) or w.startswith(t)):
        return 0.85
    return 0.7 if edits(t, w) <= (1 if len(t) <= 5 else 2) else 0.0


def vocabulary(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9]))) for _ in range(80)]


def test_matches_are_brute_force(spark):
    words, terms = vocabulary(1) + ["ab", "éabc", "", None], vocabulary(2)[:60] + ["abca", "éab", "", None]
    got = fuzzy.matches(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    want = {(t, w): c for t in set(terms) if t for w in set(words) if w and (c := credit(t, w))}
    assert {(r["term"], r["word"]): r["credit"] for r in got} == want and len(got) == len(want)
    none = spark.createDataFrame([], "word string")
    assert fuzzy.matches(none, spark.createDataFrame([("a",)], "term string")).count() == 0
    assert fuzzy.matches(none.union(spark.createDataFrame([("a",)], "word string")), none.withColumnRenamed("word", "term")).count() == 0


def test_left_out(spark):
    got = spark.createDataFrame([("abc",), ("a",), ("",)], "w string").select("w", F.array_sort(fuzzy.left_out(F.col("w"), 2)).alias("g"))
    assert {r["w"]: r["g"] for r in got.collect()} == {"abc": ["a", "ab", "abc", "ac", "b", "bc", "c"], "a": ["", "a"], "": [""]}


def test_lexical_scores(spark, monkeypatch):
    held = spark.createDataFrame([(1, "under"), (1, "thee"), (2, "undr"), (3, "zzz"), (None, "under")], "key int, word string")
    terms = spark.createDataFrame([("q", "under"), ("q", "thered"), ("q", "under"), ("r", "qqqqqq")], "query string, term string")
    for most in (fuzzy.BROADCAST_MATCHES, 0):
        monkeypatch.setattr(fuzzy, "BROADCAST_MATCHES", most)
        got = {(r["key"], r["query"]): r["lexical"] for r in fuzzy.lexical_scores(held, terms).collect()}
        assert got == {(1, "q"): (1.0 + 0.7) / 2, (2, "q"): 0.35, (None, "q"): 0.5}


@pytest.mark.parametrize("values", [[], [None], [3.0], [2.0] * 50, [1.0, None, 2.0], list(range(100)), [1e308, -1e308, 0.0, 5.0, 5.0], [math.inf, 1.0, -math.inf], [1.0, math.nan, math.nan], [10.0**i for i in range(-300, 300, 60)]])
def test_percentile_by_selection(spark, monkeypatch, values):
    monkeypatch.setattr(selection, "RANGES", 4)
    monkeypatch.setattr(selection, "FEW", 3)
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    for p in (0.0, 0.25, 1.0):
        got, want = selection.exact_percentile(df, p), df.agg(F.expr(f"percentile(v, {p}D)")).first()[0]
        assert got == want or math.isnan(got) and math.isnan(want)
    assert entities.fallback_score(df.withColumnRenamed("v", "score").filter("score = 3")).first()["fallback"] in (0.0, 3.0)


def test_percentile_of_random_values(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGES", 16)
    monkeypatch.setattr(selection, "FEW", 10)
    rng = random.Random(2)
    values = [(rng.choice([round(rng.gauss(0, 1), 2), rng.lognormvariate(0, 5)]),) for _ in range(3000)]
    df = spark.createDataFrame(values, "v double")
    for p in (0.25, 0.999):
        assert selection.exact_percentile(df, p) == df.agg(F.expr(f"percentile(v, {p}D)")).first()[0]


def brute_pages(chunks, subs, sections, floor, top):
    out = {}
    for page in {c[0] for c in chunks}:
        for query in {s[0] for s in subs}:
            own = [s for s in subs if s[0] == query and s[2] is not None]
            scored = []
            for _, sec, o, block, q in (c for c in chunks if c[0] == page and c[4] is not None):
                if any(len(s[2]) != len(q) for s in own):
                    continue
                cosine = round(sum(np.dot(q, s[2]) for s in own) / len(own) / 127**2, 8)
                words = {w for p, s, w in sections if p == page and s == sec}
                lexical = sum(sum(max([credit(t, w) for w in words], default=0.0) for t in set(s[3])) / len(set(s[3])) if s[3] else 0.0 for s in own) / len(own)
                if cosine >= floor:
                    scored.append((-round(cosine + 0.15 * lexical, 8), o, block))
            seen, best = set(), []
            for s, o, block in sorted(scored):
                if block not in seen:
                    seen.add(block)
                    best.append((o, block, -s))
            if best:
                out[page, query] = best[:top]
    return out


@pytest.mark.parametrize("sliced", [False, True])
def test_pages_are_ranked_as_one_by_one(spark, monkeypatch, sliced):
    if sliced:
        monkeypatch.setattr(retrieval, "BROADCAST_CODES", 40)
    rng = np.random.default_rng(3)
    code = lambda n=6: rng.integers(-127, 128, n).tolist()
    same = code()
    chunks = [(p, f"s{i % 5}", i, i // 2, same if i % 3 == 0 else code()) for p in ("a", "b", "c") for i in range(24)] + [("a", "s1", 99, 50, None), ("b", "s1", 99, 50, code(5)), ("d", "x", 0, 0, code())]
    vocab = [w for w in vocabulary(4) if len(w) > 3]
    sections = [(p, f"s{i}", w) for p in "abc" for i in range(5) for w in rng.choice(vocab, 6)]
    subs = [(q, i, code(), [str(t) for t in rng.choice(vocab, 2)]) for q in range(4) for i in range(1 + q % 3)] + [(9, 0, code(5), ["abca"]), (9, 1, None, ["abca"]), (10, 0, code(), []), (11, 0, code(), ["zz"]), (11, 1, code(4), ["zz"])]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = retrieval.rank_pages(make(chunks, "page string, sec string, ord int, block int, q array<tinyint>"), make(subs, "query int, sub int, q array<tinyint>, terms array<string>"), make(sections, "page string, sec string, word string"), -0.1, top=4).collect()
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault((r["page"], r["query"]), []).append((r["ord"], r["block"], r["score"]))
    want = brute_pages(chunks, subs, sections, -0.1, 4)
    assert have.keys() == want.keys()
    for k in want:
        assert [x[:2] for x in have[k]] == [x[:2] for x in want[k]] and np.allclose([x[2] for x in have[k]], [x[2] for x in want[k]], atol=2e-8)


@pytest.mark.parametrize("sliced", [False, True])
def test_nearest_takes_the_best_of_all_blocks(spark, monkeypatch, sliced):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    if sliced:
        monkeypatch.setattr(retrieval, "BROADCAST_CODES", 60)
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.integers(-127, 128, 5) if i % 4 else np.full(5, 90)).tolist()) for i in range(60)] + [(100, [1] * 3), (101, None), (None, [1] * 5)]
    queries = [(i, q) for i, q in vectors[:6]] + [(7, None), (8, [127] * 7)]
    df = spark.createDataFrame(vectors, "key long, q array<tinyint>").repartition(4)
    got = retrieval.nearest(df, spark.createDataFrame(queries, "query long, q array<tinyint>"), 0.1, top=5).collect()
    want = set()
    for i, q in queries:
        if q is not None:
            each = sorted((-round(sum(a * b for a, b in zip(q, v)) / 127**2, 8), k) for k, v in vectors if k is not None and v is not None)  # noqa: B905
            want |= {(i, k, -s, n + 1) for n, (s, k) in enumerate(each[:5]) if -s >= 0.1}
    assert {tuple(r) for r in got} == want
    assert retrieval.nearest(df, spark.createDataFrame([], "query long, q array<tinyint>"), 0.1).count() == 0


def test_words_and_tokens_of_folded_texts(spark):
    texts = ["Élève, œuvre ß ﬁn STRASSE straße İx", "plain ASCII text_with 12 ab", "", None, "áb élan ½ ™ x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens(F.col("t")).alias("k"), X.distinct_words(F.col("t")).alias("w"), F.array_distinct(X.fold_words(F.col("t"))).alias("f"), X.ascii_fold(F.upper(F.coalesce("t", F.lit("")))).alias("a"))
    import re

    for r in got.collect():
        assert set(r["k"]) == {w for w in re.split("[^A-Z0-9]+", r["a"]) if w} and len(r["k"]) == len(set(r["k"]))
        assert r["w"] == r["f"]
