"""Operators 11 to 13 against brute force, literal pages and odd tables."""

import hashlib
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import audit, lloyd, maintext

# 11


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(1, 5), st.integers(0, 2**31), st.sampled_from([2, 30, 1 << 26]))
def test_cover_tree_and_nearest(n, width, seed, spread):
    rng = np.random.default_rng(seed)
    points = np.unique(rng.integers(-spread, spread, (n, width), endpoint=True), axis=0)
    tree = lloyd.CoverTree(points)
    far = np.sqrt((((points[:, None] - points[None]).astype(float)) ** 2).sum(-1))
    assert len(tree.nodes[0]) == 1 and len(tree.nodes[-1]) == len(points)
    for level, (nodes, up) in enumerate(zip(tree.nodes, tree.above, strict=True)):
        assert (far[np.arange(len(points)), up] <= tree.radii[level][up] + 1e-9).all()
        if level:
            assert set(tree.nodes[level - 1]) <= set(nodes)  # nested
        if level and spread < 1000 and len(nodes) < len(points):
            cover = far[0].max() / 2**level
            apart = far[np.ix_(nodes, nodes)] + np.where(np.eye(len(nodes)), np.inf, 0)
            assert apart.min() > cover * (1 - 1e-9)
    centroids = rng.integers(-spread, spread, (7, width), endpoint=True).tolist() * 2  # ties
    other, number = lloyd.centroid_tree(centroids)
    k, d2, compared = lloyd.nearest(tree, other, number)
    every = ((points[:, None] - np.array(centroids)[None]) ** 2).sum(-1)
    assert k.tolist() == every.argmin(1).tolist() and d2.tolist() == every.min(1).tolist() and compared <= len(points) * len(other.points)


def test_pairs_are_pruned():
    rng = np.random.default_rng(1)
    middles = rng.integers(-5000, 5000, (40, 64))
    points = np.unique(np.repeat(middles, 20, 0) + rng.integers(-20, 20, (800, 64)), axis=0)
    tree, number = lloyd.centroid_tree(middles.tolist())
    _, _, compared = lloyd.nearest(lloyd.CoverTree(points), tree, number)
    assert compared < 0.05 * len(points) * 40


def brute_lloyd(rows, k, rounds, width, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    place = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (place(r[0]), r[1]))[:k]]
    for last in [False] * rounds + [True]:
        own = [min(range(len(centroids)), key=lambda c, v=v: (sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True)), c)) for _, v in kept]
        if last:
            return sorted(((i, c, sum((a - b) ** 2 for a, b in zip(v, centroids[c], strict=True))) for (i, v), c in zip(kept, own, strict=True)), key=str), centroids
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, [0.25, -0.5, 1.0, 0.0]) for i in range(40)]  # many copies
    rows += [(7, rows[7][1]), (8, [9.0, 9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3, 0.4]), (None, None), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5)]
    return rows + [(204, [1.0, None, 1.0, 1.0]), (205, [float("nan")] * 4), (206, [float("inf"), 0.0, 0.0, 0.0]), (207, [-0.001] * 4)]


@pytest.mark.parametrize("k", [1, 6, 500])
def test_lloyd_is_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lloyd, "BLOCK", 16)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit(1) for c in ("cluster", "distance", "n", "label", "points")})
    kept = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, centroids = brute_lloyd(kept, k, 3, 4, 256)
    got, found = lloyd.lloyd(df, k=k, rounds=3, width=4)
    assert sorted(map(tuple, got.collect()), key=str) == want and found == centroids


def test_lloyd_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert lloyd.report(none).count() == 0 and lloyd.report(none.limit(0)).count() == 0
    with pytest.raises(ValueError, match="beyond"):
        lloyd.lloyd(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), width=4)


# 12

LONG = "A paragraph of the article, which goes on for some time, so that its ratio is high and it is part of the core. " * 2
P = f"<p>{LONG}</p>"
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("no markup at all &amp; one&nbsp;line", "no markup at all & one line"),
        ("<script>var a = '<p>x</p>';</script><style>p{}</style><title>t</title>", ""),
        (f"<nav><a href=1>Home</a></nav><!-- {P} --><article><h1>T</h1>{P}<p>Of.</p></article><footer>&copy; x</footer>", f"T {TEXT} Of."),
        ("<article><p>a<b>b</b>c &eacute;&#8217;\n\n d<br>e<p>f<ul><li>g<li>h</ul><table><tr><td>i<td>j</table></article><a href='x", "abc é’ d e f g h i j"),
        (f"<article><h1>T</h1>{P}<aside>side</aside><div class='ad'>buy</div><div class='share-buttons'>Share</div><form><input><p>mail</p></form>{P}<section id=comments><article>{P}</article></section></article>", f"T {TEXT} {TEXT}"),
        (f"<div class=nav><a>Home</a></div><div id=content><h1>T</h1>{P}<p>Of.</p>{P}</div><div class='right sidebar'>{P}</div><div id='cookie-notice'>We use cookies.</div>", f"T {TEXT} Of. {TEXT}"),
        (f"<div><ul><li><a href=1>Home</a><li><a href=2>About us</a></ul></div><div><h1>T</h1>{P}<ul><li>one<li>two</ul></div><div><p>2020</p></div>", f"T {TEXT} one two"),
        (f"<form id=page><div class='page-header'>Site</div><div class='content-with-sidebar'><h1>T</h1>{P}</div></form>", f"T {TEXT}"),
        (f"<nav><ul><li><a>never closed</a><article><h1>T</h1>{P}", f"T {TEXT}"),
        (f"<article><header><h1>T</h1><p>by x</p></header>{P}<p hidden>no</p><span class=ad><span>no</span> no</span></article>", f"T {TEXT}"),
        (f"<main><h2>List</h2><article class=teaser><p>no</p></article>{P}</main><div>{P}</div>", f"List {TEXT}"),
        ("<div>" * 2000 + "deep" + "</div>" * 2000, "deep"),
    ],
)
def test_main_text(html, want):
    assert maintext.main_text(html) == want


def test_long_unclosed_pages_take_time_in_proportion():
    html = "<article>" + "<font>" * 50_000 + "<p>y" * 50_000
    assert maintext.main_text(html) == " ".join("y" * 50_000)


def test_pages_of_the_table(spark):
    import html as h

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in maintext.report(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(h.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert got[r["page_id"]] == (r["url"], want, len(want))


def test_odd_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "x")})
    assert sorted(map(tuple, maintext.report(df).collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, None, "", 0)]
    assert maintext.report(df.limit(0)).count() == 0


def test_smoothing_is_an_average():
    assert np.allclose(maintext.smoothed(np.full(7, 3.0)), 3.0) and maintext.smoothed(np.array([0.0, 0, 9, 0, 0])).argmax() == 2


# 13


def brute_audit(docs, labels):
    texts = [(i, s or "", t or "") for i, t, s in docs]
    good, toxic = ({i for i, *v in labels if i is not None and v[c] == 1} for c in (0, 1))
    by_part = defaultdict(list)
    for i, part, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and u == t for j, _, u in texts)
        by_part[part].append((i, {f for f, x in fails.items() if x}))
    out = set()
    for part, rows in by_part.items():
        credit = defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for n, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                credit[f] += len(gone)
                steps.append((part, "".join(order), n + 1, f, len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out |= {(*s[:3], *s[4:], credit[s[3]]) for s in steps}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS", 1)
    monkeypatch.setattr(audit, "CHUNK", 50)
    long = " ".join(f"word{i}" for i in range(250))
    docs = [(1, long, "a"), (2, long, "b"), (2, long, "a"), (3, long + " #", None), (4, "x " * 300, "a"), (5, "x " * 300, None), (6, None, "a"), (7, "", "b"), (None, "", "a"), (None, long, ""), (8, "ÄÖ ABC\x0b\x85é z", "b"), (1, long, "a"), (9, long.upper(), "c"), (10, "no label 100%", "c")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (5, 1, None), (6, 0, 0), (7, 1, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).withColumns({c: F.lit(1) for c in ("part", "fails", "digest", "least", "quality", "n")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in ("part", "fails", "text")})
    got = audit.report(df, marks).select(*COLUMNS).collect()
    assert len(got) == len(set(map(tuple, got))) == 600 * 4
    assert set(map(tuple, got)) == brute_audit(docs, labels)
    assert audit.report(df.limit(0), marks).count() == 0
    assert audit.report(df.limit(1), marks.limit(0)).count() == 600


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbé #|\t\n\x0b\x0c\r\x1c\x85 ", max_size=60))
def test_word_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert audit.word_counts(text.encode()) == (len(words), len(set(words)))


def test_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    assert all(table[m, o] == next((s for s, f in enumerate(order) if m >> f & 1), 5) for m in range(32) for o, order in enumerate(audit.ORDERS))
