"""Sources and operators on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from folio.operators import entities, freshness, html_blocks, incremental, retrieval
from folio.sources import catalog
from folio.streaming import admission

PAGE = """<div id="textDocument"><p class="AmmAnnexeTitre1">4. Données</p>
<p class="AmmAnnexeTitre2">4.1 Indications</p><p>Traitement des douleurs modérées chez l\x92adulte.</p>
<p>Sans objet.</p><script>var x = "</p>";</script>
<table><tr><th>Population</th><th>Dose</th></tr><tr><td>Adulte</td><td>500 mg par jour</td></tr></table>
<p class="AmmAnnexeTitre1">5. Propriétés</p><p>Traitement des douleurs modérées chez l’adulte.</p>
<p class="AmmAnnexeTitre1"></p><p class="AmmAnnexeTitre1">6. Vide</p></div>"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chunks_follow_sections_and_keep_a_body_once(spark):
    got = rows(html_blocks.chunks(spark.createDataFrame([("a", PAGE), ("b", None), ("c", "")], "key string, html string")))
    assert [(r[2], r[4]) for r in got] == [
        ("sec-0", "4. Données > 4.1 Indications\nTraitement des douleurs modérées chez l’adulte."),
        ("sec-0", "4. Données > 4.1 Indications\nPopulation: Adulte; Dose: 500 mg par jour"),
    ]


def test_own_section_ids_stay(spark):
    html = '<h1 id="sec-4">A</h1><p>one two three four five six</p><h1>B</h1><p>one two three four five seven</p>'
    got = rows(html_blocks.chunks(spark.createDataFrame([("a", html)], "key string, html string")))
    assert [r[2] for r in got] == ["sec-4"]


def test_long_sections_lose_no_tail(spark):
    body = " ".join(f"Phrase numéro {i} du texte." for i in range(4000)) + " La cible est ici."
    got = html_blocks.chunks(spark.createDataFrame([("a", f"<h1>A</h1><p>{body}</p>")], "key string, html string")).orderBy("ord").collect()
    assert len(got) > 160 and "La cible est ici." in got[-1]["chunk"]
    assert " ".join(c["chunk"].split("\n", 1)[1] for c in got) == body


def test_long_tables_lose_no_row(spark):
    n = {"a": 10_100, "b": 61, "c": 60}  # lines of a page; the earlier code kept 60 a table, and 10,000 chunks a page
    table = lambda k: "".join(f"<tr><td>patient {k}{i}</td><td>{i} mg par jour</td></tr>" for i in range(n[k]))
    pages = [(k, f"<h1>A</h1><table><tr><th>Population</th><th>Dose</th></tr>{table(k)}</table><p>Texte {k} derrière le tableau.</p>") for k in n]
    got = html_blocks.chunks(spark.createDataFrame(pages, "key string, html string")).orderBy("key", "ord").collect()
    for k in n:
        mine = [r for r in got if r["key"] == k]
        assert [r["ord"] for r in mine] == list(range(n[k] + 1)) and {r["sec"] for r in mine} == {"sec-0"}
        assert [r["chunk"] for r in mine] == [f"A\nTexte {k} derrière le tableau.", *(f"A\nPopulation: patient {k}{i}; Dose: {i} mg par jour" for i in range(n[k]))]


def test_small_pieces_join_the_one_before(spark):
    cases = {("a" * 159, "b" * 300): ["a" * 159 + " " + "b" * 300], ("a" * 160, "b" * 300): ["a" * 160, "b" * 300], ("a" * 900, "b" * 100): ["a" * 900, "b" * 100], (): []}
    for pieces, want in cases.items():
        df = spark.createDataFrame([(list(pieces),)], "p array<string>")
        assert df.select(html_blocks.merged(F.col("p")).alias("m")).first()["m"] == want


def test_toc(spark):
    html = "<h1>A</h1><h2>A1</h2><h2>A2</h2><h3>deep</h3><h1></h1><h1>B</h1><h2>B1</h2>"
    b = html_blocks.blocks(spark.createDataFrame([("a", html)], "key string, html string"))
    got = {r["title"]: (r["id"], r["parent"]) for r in html_blocks.table_of_contents(b).collect()}
    assert got == {"A": ("sec-0", None), "A1": ("sub-0", "sec-0"), "A2": ("sub-1", "sec-0"), "B": ("sec-1", None), "B1": ("sub-2", "sec-1")}


def test_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_bytes("1\tDOLIPRANE é\n2\t\"X\"\n1\tSECOND\nshort\n\tz\n".encode("latin-1"))
    p = str(tmp_path / "c.tsv")
    assert [(r["key"], r["name"]) for r in catalog.catalog(spark, p).orderBy("file_order").collect()] == [("1", "DOLIPRANE é"), ("2", '"X"'), ("1", "SECOND")]
    assert rows(catalog.names(spark, p)) == [("1", "SECOND"), ("2", "X")]
    assert catalog.catalog(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "f.jsonl").write_text('{"term":"a","type":"x","score":1}\n\n{"term":"b"}\n{"term":"c d","score":3}\n')
    assert rows(catalog.frequency(spark, str(tmp_path / "f.jsonl"))) == [("a", 1.0), ("c d", 3.0)]
    (tmp_path / "m.json").write_text('{"1":{"last_fetch":"2024-01-01T00:00:00Z","status":"ok"},"2":{"last_fetch":"bad"}}')
    assert rows(catalog.fetch_dates(catalog.manifest(spark, str(tmp_path / "m.json")))) == [("1", dt.date(2024, 1, 1))]
    (tmp_path / "bad.json").write_text("[1")
    assert catalog.manifest(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "b.tsv").write_text('k\th\n1\t"line ""one""\nline two"\n2\t\n')
    assert rows(catalog.baseline(spark, str(tmp_path / "b.tsv"))) == [("1", 'line "one"\nline two'), ("2", "")]


def test_run_on_json(spark):
    text = '{"meta":{},"data":[{"id":"1","type":"p","translations":{"fr":"u"}},{"id":"2"}\n {"id":"3"} 7, oops'
    got = rows(catalog.run_on_json(spark.createDataFrame([(text,), ("junk",), (None,)], "value string")).select("ord", "id", "translations"))
    assert got == [(0, "1", {"fr": "u"}), (1, "2", {}), (2, "3", {})]


def test_overlays_and_merge(spark, tmp_path):
    import gzip

    d = tmp_path / "o"
    d.mkdir()
    (d / "00000001.html").write_text("live")
    (d / "00000002.html").write_text("")
    (d / "00000003.html.gz").write_bytes(gzip.compress("zipped".encode()))
    (d / "00000004.html").write_text("")
    (d / "notakey.html").write_text("x")
    o = catalog.overlays(spark, str(d), "rcp")
    base = spark.createDataFrame([("00000001", "old"), ("00000002", "kept"), ("00000004", ""), ("00000005", "plain")], "key string, html string")
    got = rows(catalog.merged(base, o, base_date=F.lit("2020-01-01")))
    assert got == [("00000001", "live", None, False), ("00000002", "kept", "2020-01-01", True), ("00000003", "zipped", None, False), ("00000005", "plain", "2020-01-01", False)]
    assert rows(catalog.present(base, o)) == [("00000001",), ("00000003",), ("00000005",)]


def test_scoring(spark):
    e = entities.signals(spark.createDataFrame([("1", "PARACETAMOL CODEINE"), ("2", "IBUPROFENE"), ("3", "RIEN")], "key string, name string"))
    t = spark.createDataFrame([("paracetamol", 5.0), ("paracetamol codeine", 9.0), ("ibuprofene", 2.0), ("ibuprofene codeine", 50.0), ("--", 0.0)], "term string, score double")
    assert rows(entities.score(e, t)) == [("1", 9.0, True), ("2", 2.0, True), ("3", 2.0, False)]


def test_link_terms(spark):
    entries = spark.createDataFrame([("1", "DOLIPRANE 500, x", 0), ("2", "DOLIPRANE 1000, y", 1), ("3", "AUTREMENT, z", 2), ("4", "SANSPAGE, z", 3)], "key string, name string, file_order long")
    comp = spark.createDataFrame([("1", 2, ["PARACETAMOL"]), ("2", 1, ["PARACETAMOL"]), ("3", 1, ["SODIUM"])], "key string, n_links long, tokens array<string>")
    scores = spark.createDataFrame([(str(i), 1.0) for i in range(1, 5)], "key string, score double")
    wl = spark.createDataFrame([("DOLIPRANE",), ("PARACETAMOL",), ("SODIUM",), ("SANSPAGE",), ("AUTREMENT",)], "term string")
    pages = spark.createDataFrame([("1",), ("2",), ("3",)], "key string")
    names = spark.createDataFrame([("1", "Doli 1"), ("2", "Doli 2")], "key string, name string")
    assert rows(entities.link_terms(entries, comp, scores, wl, pages, names)) == [("DOLIPRANE", "2", "2-doli-2", "Doli 2"), ("PARACETAMOL", "2", "2-doli-2", "Doli 2")]
    docs = spark.createDataFrame([("1", "Le doliprane et le paracétamol, doliprane."), ("2", "doliprane")], "key string, text string")
    links = entities.links_in_text(docs, entities.link_terms(entries, comp, scores, wl, pages, names))
    assert rows(links) == [("1", 1, "DOLIPRANE", "2"), ("1", 2, "PARACETAMOL", "2")]
    assert rows(entities.linked_targets(links)) == [("1", ["2"])]
    assert links.count() == 2 and entities.links_in_text(docs, entities.link_terms(entries, comp, scores, wl, pages, names), budget=1).count() == 1


def test_word_prefix(spark):
    left = spark.createDataFrame([("abilify",), ("ozempic",), ("ozem",)], "name string")
    right = spark.createDataFrame([("abilify maintena", 0), ("abilify", 1), ("ozempic wegovy", 2)], "name string, ord long")
    assert rows(entities.word_prefix_join(left, right)) == [("abilify", "abilify"), ("ozempic", "ozempic wegovy")]


def test_search_limits_before_ranking(spark):
    index = spark.createDataFrame([(f"{i:04d}", f"zz abc {i}", None) for i in range(60)] + [("9999", "abc", "s"), ("0000a", "x", "ABCÉ")], "key string, name string, sub string")
    got = retrieval.instant_search(index, "abc").collect()
    assert len(got) == 15 and "9999" not in {r["key"] for r in got}
    assert retrieval.instant_search(index, "  ").count() == 0


def test_ranking(spark):
    chunks = spark.createDataFrame([(0, "a", [127, 0], ["foie"]), (1, "a", [120, 10], ["foie"]), (2, "b", [0, 127], ["douleur"]), (3, "c", [90, 90], ["douleurs"])], "ord int, block string, q array<tinyint>, words array<string>")
    q = spark.createDataFrame([([127, 0], ["douleur"])], "q array<tinyint>, terms array<string>")
    got = retrieval.rank_passages(chunks, q, floor=0.5).collect()
    assert [(r["ord"], r["rank"]) for r in got] == [(0, 1), (3, 2)]
    wide = spark.createDataFrame([([127, 0, 0], ["x"])], "q array<tinyint>, terms array<string>")
    assert retrieval.rank_passages(chunks, wide, floor=-1.0).count() == 0
    assert retrieval.sub_queries("abc // hello there//hello there// second one") == ["hello there", "second one"]


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "key string, hash string")
    assert rows(incremental.plan(now, old)) == [("a", "hit"), ("b", "changed"), ("c", "new"), ("d", "gone")]
    assert rows(incremental.plan(now, old, same_version=False))[0] == ("a", "changed")
    pages = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h")], "key string, src_hash string")
    v = spark.createDataFrame([("a", "h", "m", 8), ("b", "x", "m", 8), ("c", "h", "m", 0)], "key string, src_hash string, model string, dim int")
    assert rows(incremental.stale_vectors(pages, v, "m", 8)) == [("b",), ("d",)]


def test_index_and_browse(spark):
    e = spark.createDataFrame([("2", "Éclair 1"), ("1", "ecla"), ("3", "12")], "key string, name string")
    s = spark.createDataFrame([("2", "eclair"), ("1", "sub")], "key string, text string")
    got = {r["key"]: (r["slug"], r["sub"], r["line"]) for r in incremental.search_index(e, s).collect()}
    assert got["2"][:2] == ("2-eclair-1", None) and got["1"][2] == '{"cis":"1","name":"ecla","slug":"1-ecla","sub":"sub"}'
    assert rows(incremental.browse(e)) == [("#", 1, ["3"]), ("E", 2, ["1", "2"])]
    pages = spark.createDataFrame([("/p", "2024-01-01T00:00", True), ("/q", None, False)], "path string, asof string, full boolean")
    assert incremental.sitemap("https://x", ["/", "/a", "/b"], incremental.letter_counts(e.select("name")), pages).count() == 6


def test_freshness(spark):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    r = spark.createDataFrame([("a", "2024-01-09 12:00:01", "ok"), ("b", "2024-01-08 12:00:00", "ok"), ("c", "2024-01-10 11:59:00", "error"), ("d", None, "ok")], "key string, t string, status string").withColumn("last_fetch", F.col("t").cast("timestamp"))
    keys = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate((("a", 9.0), ("b", 1.0), ("c", 2.0), ("d", 2.0), ("e", 5.0)))], "key string, score double, file_order long")
    assert [x["key"] for x in freshness.crawl_queue(keys, r, now, 2).collect()] == ["e", "c", "d", "b"]
    assert freshness.next_expiry(r.filter("key = 'b'"), now, 2 * 86400 + 50).first()["wait"] == 50.0
    lanes = spark.createDataFrame([(2.0, True, False), (9.0, True, True)], "ppm double, enabled boolean, idle boolean")
    assert tuple(freshness.catch_up(lanes, F.lit(5.0), F.lit(30.0)).first()) == (3.0, 600.0)


REQUESTS = [("l", k, f"2024-01-01 00:00:{s:02d}", src) for k, s, src in (("a", 0, "auto"), ("a", 1, "user"), ("b", 2, "auto"), ("c", 3, "auto"), ("a", 4, "done"), ("a", 5, "auto"), ("c", 6, "auto"))]


def test_admission_order(spark):
    df = spark.createDataFrame(REQUESTS, "lane string, key string, t string, source string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = [(r["key"], r["status"]) for r in admission.admit_batch(df, min_interval=60, hourly=2, capacity=10).orderBy("ts").collect()]
    assert got == [("a", "queued"), ("a", "queued"), ("b", "queued"), ("c", "busy"), ("a", "fresh"), ("c", "busy")]


def test_admission_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(REQUESTS, "lane string, key string, t string, source string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    for i, part in enumerate((df.filter("ts < '2024-01-01 00:00:03'"), df.filter("ts >= '2024-01-01 00:00:03'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b=*"))
    q = admission.admit_stream(stream, min_interval=60, hourly=2, capacity=10).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(admission.admit_batch(df, min_interval=60, hourly=2, capacity=10))
