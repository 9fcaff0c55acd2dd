"""Training-data operators against brute force, library results, SQL twins and held-out labels."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import bpe, decontam, fingerprint, graph, langid, neardup, quality, queries, repeats, secrets, sharding, urls

SF = "/root/testdata/sf0.001"
VOCAB = P.path("byte_bpe_50k.tiktoken")
ODD = [(1, "x", None, "e"), (2, "x", "", "e"), (2, "x", "", "e"), (None, "y", "Null id text of five words", None), (3, None, "short", "z"), (4, "x", "é" * 3000, "z"), (4, "x", "same id, other text", "z"), (5, "x", "1234 !!", "z"), (6, "x", "1234 !!", "z")]
ODD_SCHEMA = "doc_id long, lang string, text string, source string"


def odd(spark):
    """Nulls in every column, empty and repeated texts and rows, an id with two texts, clashing extra columns."""
    extra = {c: F.lit(1) for c in ("key", "n", "spans", "score", "win", "content", "component", "rep", "fingerprint", "token_ids", "words", "run")}
    return spark.createDataFrame(ODD, ODD_SCHEMA).withColumns(extra)


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=str) == sorted((tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall()), key=str)


# 1 and 7


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert got["a"] > 0.97 and 0 <= got["lo"] and got["hi"] <= 1


def test_language_of_odd_rows(spark):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.report(odd(spark)).collect()]
    assert len(got) == len(ODD) and all((p == "und") == (s == 0.0) for _, p, s in got)
    assert {p for i, p, _ in got if i in (1, 2, 5, 6)} == {"und"}
    assert langid.report(empty(spark)).count() == 0


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows = [(np.array([y * 10 + int(rng.integers(5)), 100 + i % 300]), np.array([1.0, 0.05]), y) for i, y in enumerate(rng.integers(0, 2, 400).tolist())]
    w, b = langid.ftrl(rows, 2)
    assert (w != 0).mean() < 0.01
    assert np.mean([(x @ w[i] + b).argmax() == y for i, x, y in rows]) > 0.99
    logits = np.array([[4.0, 0.0]] * 100)
    assert langid.fit_temperature(logits, np.array([0] * 75 + [1] * 25)) == pytest.approx(4 / np.log(3), rel=0.05)


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.report(docs, labels).join(labels, "doc_id").filter("held_out").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    assert {r["quality"]: r["p"] > 0.5 for r in got} == {0: False, 1: True} and all(abs(r["p"] - r["quality"]) < 0.2 for r in got)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, None), (3, 0, None), (3, 1, None), (None, 1, 1), (77, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.report(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality.report(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.report(empty(spark), labels).count() == 0


# 2


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("(abc|xyzw)?def") == [frozenset({"def"})]
    assert secrets.trigram_query("abc|d") is None


@given(st.text(alphabet="paswordtkenAKI_=: \"'0123456789abcdef", max_size=80))
@settings(max_examples=300)
def test_trigram_queries_lose_no_match(text):
    for r in secrets.RULES:
        query = secrets.trigram_query(r.pattern)
        if query and re.search(r.pattern, text, re.IGNORECASE | re.ASCII if r.any_case else 0):
            assert any(all(t in text.lower() for t in need) for need in query)


def test_secret_spans(spark):
    texts = ["é password: hunter2x, TOKEN='ab' token=secret=abcdefgh", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "x" + "0a" * 12 + "g" + "f" * 23, "secret: token: abcdefgh", None, "", "ghp_" + "Z1" * 18, "-----BEGIN RSA PRIVATE KEY-----"]
    got = [r["spans"] for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["assign:2:20,assign:33:54", "access:0:20", "hex:1:25", "", "", "", "code_host:0:40", "private_key:0:31"]
    clean = [r["text"] for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert clean[:2] == ["é [secret], TOKEN='ab' [secret]", "[secret] AKIA" + "B" * 15] and clean[4] is None and clean[5] == ""
    assert secrets.scan(odd(spark)).count() == len(ODD) and secrets.scan(empty(spark)).count() == 0


# 3


def _family():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        b = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            b[rng.randrange(200)] = rng.choice(words)
        docs.append((i, " ".join(b)))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(150))) for i in range(40)] + [(300, None), (301, ""), (302, ""), (303, "a b"), (304, "A, b!"), (305, "a b"), (200, docs[3][1])]
    rng.shuffle(docs)
    return docs


def _root(root, x):
    while root[x] != x:
        x = root[x]
    return x


def weighted_links(docs):
    """All pairs of distinct texts with a weighted Jaccard similarity of 0.8 or more, by an inverted index of their shingles."""
    first = {}
    for i, t in sorted(docs):
        first.setdefault(t, i)
    parts = {i: neardup.shingles(t) for t, i in first.items() if t is not None}
    parts = {i: x for i, x in parts.items() if len(x[0])}
    load = np.zeros(1 << neardup.DF_BITS, np.int64)
    for ids, _ in parts.values():
        load[np.unique(ids >> np.uint32(32 - neardup.DF_BITS))] += 1
    n, own = max(len(parts), 1), np.maximum(load - np.median(load), 0)
    share = (np.log((1.0 + n) / (1.0 + own)) / np.log(1.0 + n)).clip(0, 1).astype(np.float32)
    weights = {i: dict(zip(x[0].tolist(), neardup.weigh(*x, share).tolist())) for i, x in parts.items()}
    where, least = {}, Counter()
    for i, w in weights.items():
        for g, x in w.items():
            for j, y in where.get(g, ()):
                least[j, i] += min(x, y)
            where.setdefault(g, []).append((i, x))
    total = {i: sum(w.values()) for i, w in weights.items()}
    return {(i, j): s for (i, j), m in least.items() if (s := m / (total[i] + total[j] - m)) >= neardup.SIMILARITY}


def _classes(docs):
    root, first = {i: i for i, _ in docs}, {}
    for i, t in sorted(docs):
        if t is not None:
            root[i] = first.setdefault(t, i)
    for i, j in weighted_links(docs):
        a, b = _root(root, i), _root(root, j)
        root[max(a, b)] = min(a, b)
    return {i: _root(root, i) for i in root}


@pytest.mark.parametrize(("group", "split"), [(512, 8192), (4, 8)])
def test_near_duplicate_classes(spark, monkeypatch, group, split):
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "SPLIT", split)
    docs = _family()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert got == _classes(docs)
    if group == 512:
        assert sorted(r["doc_id"] for r in neardup.deduplicate(df).collect()) == sorted(set(got.values()))


def test_links_of_all_documents(spark):
    """All links between documents, and the classes, by weighted similarity: none is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    links = weighted_links(texts)
    assert links and all(got[i] == got[j] for i, j in links)
    assert got == _classes(texts)


def _one_bucket(real):
    def one_bucket(shared):
        inner = real(shared)

        def sample(batches):
            for b in inner(batches):
                # every text in one bucket of the first band, alone in its other bands
                b["bands"] = [np.array([7, *(1000 + rep * 100 + k for k in range(1, len(x)))], np.int64) for rep, x in zip(b["rep"], b["bands"], strict=True)]
                yield b

        return sample

    return one_bucket


def test_all_pairs_of_a_large_bucket_are_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_sampler", _one_bucket(neardup._sampler))
    monkeypatch.setattr(neardup, "GROUP", 16)
    rng, docs = random.Random(6), []
    for i in range(100):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "end"]))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_a_large_bucket_is_split_by_further_bands(spark, monkeypatch):
    """Texts that share a passage meet in one bucket; pairs of near copies among them are found in its parts."""
    for name, value in (("GROUP", 8), ("SPLIT", 16)):
        monkeypatch.setattr(neardup, name, value)
    rng, docs = random.Random(9), []
    common = [f"c{i}" for i in range(120)]
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        docs += [(2 * i, " ".join(common + words)), (2 * i + 1, " ".join([*common, *words[:-1], "end"]))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _classes(docs) == {i: i - i % 2 for i, _ in docs}


def test_one_of_each_class_stays_where_ids_repeat(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, "a b c d e f"), (4, text), (2, text), (2, text), (None, text), (None, None), (None, None), (7, None), (4, "a b c d e f")]
    got = Counter(tuple(r) for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(4, "a b c d e f"), (2, text), (None, None), (7, None)])


def test_an_id_with_several_texts_loses_none(spark):
    text = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(text), " ".join(f"x{i}" for i in range(60)), " ".join([*text, "more"])
    rows = [(4, a), (4, b), (1, c), (9, a + " end"), (9, b + " end"), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in neardup.deduplicate(df).collect()) == Counter([(1, c), (4, b)])
    two = spark.createDataFrame([(4, a), (4, c), (4, None)], "doc_id long, text string")
    left = [tuple(r) for r in neardup.deduplicate(two).collect()]
    assert len(left) == 2 and (4, None) in left  # of two alike texts of one id the one of least md5
    got = neardup.classes(df).collect()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(4, 1), (4, 4), (1, 1), (9, 1), (9, 4)}
    assert all(r["n_links"] >= 1 and r["similarity"] >= 0.8 and r["linked_id"] in (1, 4, 9) for r in got)


def test_links_connect_each_class(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    links = weighted_links([tuple(r) for r in docs.collect()])
    rows = neardup.classes(docs).collect()
    for r in rows:
        if r["n_links"]:
            assert links[min(r["doc_id"], r["linked_id"]), max(r["doc_id"], r["linked_id"])] == pytest.approx(r["similarity"], abs=1e-5) if (min(r["doc_id"], r["linked_id"]), max(r["doc_id"], r["linked_id"])) in links else r["similarity"] >= 0.8
        else:
            assert r["linked_id"] is None and r["similarity"] is None
    assert any(r["n_links"] for r in rows)


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.classes(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["class_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert neardup.classes(empty(spark)).count() == 0 and neardup.deduplicate(empty(spark)).count() == 0
    assert neardup.deduplicate(odd(spark)).columns == odd(spark).columns


def test_samples_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(60):
        shared, x, y = (rng.integers(0, 2**32, n, dtype=np.uint32) for n in (240, 60, 60))
        a, b = np.concatenate([shared, x]), np.concatenate([shared, y])
        w = [(0.75 + (v % 5 == 0)).astype(np.float32) for v in (a, b)]
        s = neardup.samples(np.concatenate([a, b]), np.concatenate(w), np.array([0, 300, 600]))
        inner = w[0][:240].sum()
        off.append((s[0] == s[1]).mean() - inner / (w[0].sum() + w[1].sum() - inner))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


# 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2000), (None, 1), (7, None)] + [(3000, 3001 + i) for i in range(50)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(map(tuple, got.collect())) == {x: find(x) for x in root} and got.count() == len(root)
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_url_verdicts(spark):
    rows = [
        (1, "https://a.net/es/1", "<link rel='canonical' href='https://b.org/x'>"), (2, "http://b.org/x#f", ""), (3, "https://c.org/z", '<meta http-equiv="refresh" content="0; url=https://b.org/x">'),
        (4, "https://d.com/q", '<link href="//e.org/k" rel=canonical>'), (5, "https://e.org/k", None), (6, "https://a.net/fr/9", "<link rel=canonical href=//e.org/k>"), (7, None, None), (8, "nourl", ""),
        (None, "HTTPS://WWW.EXAMPLE.COM/en/1", ""), (9, "https://m.example.com/en/1?q#f", ""), (9, "https://m.example.com/en/1?q#f", ""), (10, "x://notcom/en/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in urls.report(spark, df).collect())
    assert got == Counter([
        (1, "net/es/", "block"), (2, None, "block"), (3, None, "block"), (4, "com/", "allow"), (5, None, "allow"), (6, "net/fr/", "block"), (7, None, "allow"), (8, None, "allow"),
        (None, "www.example.com/en/", "allow"), (9, "example.com/en/", "block"), (9, "example.com/en/", "block"), (10, None, "allow"),
    ])
    redirects = spark.createDataFrame([("https://new.org/", "http://a.net/es/1")], "src string, dst string")
    page = spark.createDataFrame([(1, "https://new.org", None)], "page_id long, url string, html string")
    assert urls.judge(page, urls.rule_table(spark), redirects).first()["verdict"] == "block"
    assert urls.report(spark, df.limit(0)).count() == 0


# 5


@pytest.fixture(scope="module")
def coder():
    import regex
    import tiktoken

    ranks = bpe.load_ranks(VOCAB)
    return bpe.MergeTransducer(ranks), bpe.Pieces(regex.compile(P.PATTERN), bpe.ascii_pattern(P.PATTERN)), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeth \n'é中\U0001f600.-_=01\x1c\x85\xa0", max_size=60), st.builds(lambda c, n: c * n, st.sampled_from("ae= -é"), st.integers(0, 400))))
@settings(max_examples=400, deadline=None)
def test_tokens_are_the_librarys(coder, text):
    m, pieces, library = coder
    text = text.encode("utf-8", "ignore").decode()
    (got,) = bpe.encode_texts([text], m, pieces)
    assert list(got) == library.encode_ordinary(text)


def test_forgotten_states_change_nothing(coder, monkeypatch):
    m, pieces, library = coder
    for limit in ("MAX_STATES", "MAX_PIECES", "MAX_PAIRS"):
        monkeypatch.setattr(bpe, limit, 20)
    text = duckdb.sql(f"SELECT string_agg(text, ' ') FROM (SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 15)").fetchall()[0][0]
    (got,) = bpe.encode_texts([text], m, pieces)
    assert list(got) == library.encode_ordinary(text)


@given(st.text(alphabet=[chr(i) for i in range(128)], max_size=80))
@settings(max_examples=300, deadline=None)
def test_ascii_pieces_are_those_of_the_pattern(coder, text):
    import regex

    assert coder[1].ascii(text) == regex.findall(P.PATTERN, text)
    assert bpe.ascii_pattern(r"\b\w+") is None


@given(st.text(max_size=40), st.integers(1, 5))
def test_streamed_decoding(text, size):
    data, stream = text.encode("utf-8", "ignore"), bpe.Utf8Stream()
    assert "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.close() == data.decode()


def test_token_digests(spark, coder, monkeypatch):
    m, pieces, library = coder
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd(spark), VOCAB, P.PATTERN).collect()}
    want = set()
    for i, _, t, _ in ODD:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    apart = bpe.decode(bpe.encode(odd(spark), VOCAB, P.PATTERN), VOCAB)
    assert apart.filter("decoded <> coalesce(text, '')").count() == 0
    monkeypatch.setattr(bpe, "PART_CHARS", 30)
    few = bpe.encode_checked(odd(spark).coalesce(1), VOCAB, P.PATTERN, keep=["doc_id", "n"])
    assert few.columns == ["doc_id", "n", "token_ids", "round_trip"] and few.filter("round_trip").count() == len(ODD)
    checked = bpe.encode_checked(odd(spark), VOCAB, P.PATTERN)
    assert checked.filter("round_trip").count() == len(ODD) and [r["token_ids"] for r in checked.collect()] == [r["token_ids"] for r in apart.collect()]
    assert bpe.digests(empty(spark), VOCAB, P.PATTERN).count() == 0


# 6


def test_ranges_are_dealt_evenly(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words here "), 5).alias("text"))
    placed = fingerprint.with_next(docs, 16).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(placed) == 16 and max(r["count"] for r in placed) < 1.2 * 4000 / 16


def test_fingerprints_merge_and_estimate(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    a = " ".join(rng.choice(words) for _ in range(1000))
    b = a[: len(a) // 2] + " " + " ".join(rng.choice(words) for _ in range(500))
    r = spark.createDataFrame([(a, b)], "a string, b string").select(F.transform(F.array("a", "b"), fingerprint.shingle_hashes).alias("h")).select(
        F.get("h", F.lit(0)).alias("x"), F.get("h", F.lit(1)).alias("y")
    ).select(fingerprint.bottom_k(F.col("x")).alias("p"), fingerprint.bottom_k(F.col("y")).alias("q"), fingerprint.bottom_k(F.concat("x", "y")).alias("both"), "x", "y")
    got = r.select((fingerprint.merge(F.col("p"), F.col("q")) == F.col("both")).alias("merged"), fingerprint.resemblance(F.col("p"), F.col("q")).alias("near"), fingerprint.containment(F.col("p"), F.col("q")).alias("inside"), fingerprint.distinct_count(F.col("p")).alias("n"), "x", "y").first()
    x, y = set(got["x"]), set(got["y"])
    assert got["merged"] and abs(got["near"] - len(x & y) / len(x | y)) < 0.2 and abs(got["inside"] - len(x & y) / len(x)) < 0.25 and abs(got["n"] / len(x) - 1) < 0.4


def test_fingerprints_of_odd_rows(spark):
    got = fingerprint.neighbours(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["near_next"] == 1.0 and by[1]["fingerprint"] == [] and by[1]["near_edited"] == 1.0 and by[None]["near_next"] == 0.0
    assert by[3]["edited"] == "shor" + "s"  # of the two texts of id 4 the least is next: "same id, other text"
    assert fingerprint.report(empty(spark)).count() == 0


# 8


def _removed(docs):
    seen = Counter(t[p : p + 200] for _, t in docs for p in range(len(t) - 199))
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        yield i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("hot", [4000, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(5)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text").collect()]
    base = max((t for _, t in rows), key=len)[:3000]
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 5000, base[:700] + "é" * 150 + base[300:900], "\x00" * 450, base[50:249], base[50:250]])]
    rows += [(7, rows[7][1]), (1000, None), (None, base[:400])] + [(2000 + i, noise() + base[100:500] + noise()) for i in range(40)]
    got = Counter(map(tuple, repeats.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()))
    assert got == Counter(_removed([(i, (t or "").encode()) for i, t in rows]))


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    rng = random.Random(8)
    base = bytes(rng.randrange(97, 123) for _ in range(900))
    contents = [base[:400], base[100:600], bytes(rng.randrange(97, 123) for _ in range(420)), base[550:900], base[300:520]]
    windows, counts = np.array([len(c) - repeats.LEAST + 1 for c in contents]), np.ones(len(contents), np.int64)
    want, real = repeats._cover(contents, windows, counts), repeats.rolling
    assert any(want) and not want[2]
    monkeypatch.setattr(repeats, "rolling", lambda b, size: real(b, size) % np.uint64(5) if size == repeats.LEAST else real(b, size))
    assert repeats._cover(contents, windows, counts) == want


def test_repeats_of_odd_rows(spark):
    assert repeats.report(odd(spark)).count() == len(ODD) and repeats.report(empty(spark)).count() == 0


def test_maximal_repeats():
    text = b"abcabxabcaby"
    symbols = np.frombuffer(text, np.uint8).astype(np.int64)
    order, lcp = repeats.suffix_array(symbols, np.full(len(text), len(text)))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    left = np.where(order > 0, symbols[np.maximum(order - 1, 0)], -1 - np.arange(len(order)))
    got = {text[order[a] : order[a] + n]: sorted(order[a : b + 1].tolist()) for a, b, n in repeats.maximal_intervals(lcp, left)}
    assert got == {b"abcab": [0, 6], b"ab": [0, 3, 6, 9]}


# 9


def test_contamination_by_shuffle_is_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = items.unionByName(spark.createDataFrame([(900, "The"), (901, None), (902, "  "), (903, "and THE")], "item_id long, text string"))
    want = sorted(map(tuple, decontam.report(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.report(docs, items).collect())) == want and any(r[5] for r in want)


def test_contamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "null ID text of five WORDS", 0), (2, "Short", 0), (None, None, 0)], "item_id long, text string, n int")
    got = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontam.report(odd(spark), items).collect()}
    assert {(None, 6, 1), (3, 1, 1), (1, 0, 0), (4, 0, 0)} <= got
    assert decontam.report(odd(spark), items.limit(0)).filter("contaminated").count() == 0 and decontam.report(empty(spark), items).count() == 0


def test_proximity_looks_equally_far_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "r x x b"), (2, "r x x x b"), (3, "b x x r"), (4, "b x x x r"), (5, "x x x x x x b x x r b"), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "r b"), (8, None)], "item_id long, text string")
    for rows in (decontam.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", rows)
        assert sorted(r["doc_id"] for r in decontam.proximity_matches(decontam.build_index(docs), items, slop=3).collect()) == [1, 3, 5]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x a y b"), (2, "a " + "x " * 50 + "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["n_near"]) for r in decontam.proximity_matches(decontam.build_index(docs), items, slop=5).collect()] == [(1, 7, 1)]


# 10


def test_store(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2, target_bytes=1000)
    for i in range(5):
        store.append(spark.range(i * 10, i * 10 + 10).withColumn("v", F.lit("x")), "100", merge=True)
    assert sorted(r["id"] for r in store.read().collect()) == list(range(50))
    tiers = Counter(store.tier(r.size) for r in store.runs())
    assert max(tiers.values()) < 2 and sum(r.arrivals for r in store.runs()) == 5
    with pytest.raises(sharding.ConflictError):
        store.commit(store.runs(), store.version() - 1)
    assert sorted(r["id"] for r in store.read().collect()) == list(range(50))
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, str(tmp_path / "e")).read()


def test_runs_of_different_columns_merge(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2)
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    two = spark.createDataFrame([(2, "b", "en")], "doc_id long, text string, lang string")
    three = spark.createDataFrame([("fr", 3)], "lang string, doc_id long")
    want = {(1, "a", None), (2, "b", "en"), (3, None, "fr")}
    store.append(one, merge=False)
    store.append(two, merge=False)
    rows = lambda: {tuple(r) for r in store.read().select("doc_id", "text", "lang").collect()}
    assert rows() == {x for x in want if x[0] < 3}
    store.compact()
    assert len(store.runs()) == 1 and rows() == {x for x in want if x[0] < 3}
    store.append(three)
    assert rows() == want
    version = store.version()
    with pytest.raises(ValueError, match="doc_id is bigint in the store, not string"):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))
    assert store.version() == version and rows() == want


def test_a_writer_in_between_is_no_error(spark, tmp_path, monkeypatch):
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2) for _ in range(2))
    a.append(spark.range(1))
    real, todo = sharding.ShardStore.commit, [5, 6, 7]

    def commit(self, runs, base):  # before each of a's commits b appends
        if self is a and todo:
            b.append(spark.range(todo[0], todo.pop(0) + 1))
        return real(self, runs, base)

    monkeypatch.setattr(sharding.ShardStore, "commit", commit)
    a.append(spark.range(1, 2))
    assert sorted(r["id"] for r in a.read().collect()) == [0, 1, 5, 6, 7] and not todo
    assert max(Counter(a.tier(r.size) for r in a.runs()).values()) == 1


def test_store_keeps_its_last_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2, keep=2)
    for i in range(4):
        store.append(spark.range(i, i + 1))
    newest = store.version()
    assert [r["id"] for r in store.read(newest - 1).orderBy("id").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="not kept"):
        store.read(newest - 2)


def test_of_two_writers_one_wins(spark, tmp_path):
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    base, mine, theirs = a.version(), a._write(spark.range(3), "run-a", "1", 1), b._write(spark.range(5), "run-b", "1", 1)
    assert a.commit([mine], base) == 1
    with pytest.raises(sharding.ConflictError):
        b.commit([theirs], base)
    # what the loser wrote is no part of the store, and goes once it is old enough
    assert a.read().count() == 3
    a.vacuum()
    assert (tmp_path / "s" / theirs.parts[0]).exists()
    sharding.ShardStore(spark, str(tmp_path / "s"), grace=-60).vacuum()
    assert not (tmp_path / "s" / theirs.parts[0]).exists() and a.read().count() == 3
    assert [p.name for p in (tmp_path / "s" / "manifest").iterdir() if not p.name.endswith(".crc")] == ["00000001.json"]


def test_sharding_keeps_every_row(spark):
    got = sharding.shard(odd(spark))
    assert got.count() == len(ODD) and sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(str(r[0]) for r in ODD)
    assert sharding.shard(empty(spark)).count() == 0


def _stored(spark, monkeypatch, docs, **kw):
    """(store, result) of :func:`sharding.shard`."""
    made, real = [], sharding.ShardStore

    def keep(*a):
        made.append(real(*a))
        return made[-1]

    monkeypatch.setattr(sharding, "ShardStore", keep)
    return sharding.shard(docs, **kw), made[0]


def test_shards_hold_all_columns(spark, monkeypatch):
    docs = odd(spark)
    _, store = _stored(spark, monkeypatch, docs)
    rows = store.read(run="where").select(*docs.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, docs.collect()))


def test_shard_files_are_of_the_target_size(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"), F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source")).coalesce(1)
    _, store = _stored(spark, monkeypatch, docs, target_bytes=20_000)
    for run in store.runs():
        n = [r["n"] for r in store._read([run]).groupBy(F.input_file_name()).agg((F.count("*") * 100).alias("n")).collect()]
        assert -(-run.size // 20_000) <= len(n) <= 2 * -(-run.size // 20_000) and max(n) <= 30_000, (run, n)


def test_many_arrivals_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_ARRIVALS", 3)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    got, store = _stored(spark, monkeypatch, docs)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40)) and sum(r.arrivals for r in store.runs()) <= 3


def _simulated(sizes, fanout=4):
    store = sharding.ShardStore.__new__(sharding.ShardStore)
    store.fanout = fanout
    runs, version = [], 0
    for key, size in sizes:
        version += 1
        runs.append((f"run-{version:08d}", size, {key}))
        while True:
            tiers: dict = {}
            for r in runs:
                tiers.setdefault(store.tier(r[1]), []).append(r)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= fanout]
            if not full:
                break
            merge, version = tiers[full[0]][:fanout], version + 1
            at = runs.index(merge[0])
            runs = [r for r in runs if r not in merge]
            runs.insert(at, (f"run-{version:08d}", sum(r[1] for r in merge), set().union(*(r[2] for r in merge))))
    return {k: name for name, _, keys in runs for k in keys}, version


def test_sharding_is_as_simulated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [(r["source"], r["n"]) for r in docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("source").collect()]
    where, version = _simulated(sizes)
    got = sharding.shard(docs).select("arrival", "run", "version").distinct().collect()
    assert {r["arrival"]: r["run"] for r in got} == where and {r["version"] for r in got} == {version}


def test_components_of_a_large_hub(spark):
    """A hub of 100,000 edges with a chain behind it, and a second one, are two components."""
    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(100_000, 100_040).select("id", (F.col("id") + 1).alias("dst"))
    other = spark.range(300_000, 350_000).select(F.lit(299_999).cast("long").alias("src"), F.col("id").alias("dst"))
    got = graph.components(hub.union(chain).union(other)).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, 100_041), (299_999, 50_001)}
