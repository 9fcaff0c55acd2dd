"""What large inputs need: rows that a query moves and memory that its Python holds grow no faster than its input."""

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from folio.functions import batches, chunking
from folio.operators import entities, html_blocks, retrieval


def moved(spark, run):
    """What ``run`` returns, and the rows that its shuffles wrote."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    out = run()
    return out, sum(n for k, n in written().items() if k not in before)


def test_ranking_moves_no_row_for_a_section_and_a_query(spark):
    rng = np.random.default_rng(5)
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    chunks = make([("a", i, i, i // 2, rng.integers(-127, 128, 4).tolist()) for i in range(120)], "page string, sec int, ord int, block int, q array<tinyint>")
    sections = make([("a", i, w) for i in range(120) for w in ("alpha", "betas")], "page string, sec int, word string")
    queries = make([(q, 0, rng.integers(-127, 128, 4).tolist(), ["alpha"]) for q in range(60)], "query int, sub int, q array<tinyint>, terms array<string>")
    got, rows = moved(spark, lambda: retrieval.rank_pages(chunks, queries, sections, -2.0, top=3).collect())
    assert len(got) == 180 and {r["lexical"] for r in got} == {1.0}
    assert rows < 120 * 60  # pairs of sections and queries


def test_a_block_that_goes_on_in_the_next_batch_counts_once(spark):
    v = lambda x: [x, 0]
    chunks = spark.createDataFrame([("a", 0, i, 1 if i < 30 else i, v(60 + i % 30)) for i in range(40)], "page string, sec int, ord int, block int, q array<tinyint>")
    queries = spark.createDataFrame([(1, 0, v(127), ["x"])], "query int, sub int, q array<tinyint>, terms array<string>")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        got = retrieval.rank_pages(chunks, queries, spark.createDataFrame([("a", 0, "y")], "page string, sec int, word string"), 0.0, top=4).orderBy("rank").collect()
    finally:
        spark.conf.set(key, before)
    assert [(r["ord"], r["block"]) for r in got] == [(29, 1), (39, 39), (38, 38), (37, 37)]


def test_a_worker_takes_documents_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(batches, "PIECE_BYTES", 100)
    b = pa.RecordBatch.from_pydict({"key": list(range(9)), "html": ["x" * 40, None, "x" * 40, "y" * 30, "z" * 500, "é" * 40, "", "x" * 30, "x" * 90]})
    got = list(batches.pieces(b.slice(1), 1))
    assert [len(p) for p in got] == [3, 1, 2, 1, 1] and [k for p in got for k in p.column(0).to_pylist()] == list(range(1, 9))
    assert list(batches.pieces(b.slice(0, 0), 1)) == []


def test_blocks_of_many_documents_come_back_in_parts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, run, schema: seen.append(run) or df)
    docs = spark.createDataFrame([], "key string, html string")
    html_blocks.blocks(docs)
    import pyarrow as pa

    page = "<p>" + "</p><p>".join(f"word{i}" for i in range(2000)) + "</p>"
    b = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(300)], "html": [page] * 300})
    largest = rows = 0
    for out in seen[0](iter([b])):
        largest, rows = max(largest, len(out)), rows + len(out)
    assert rows == 300 * 2000 and largest <= batches.PIECE_ROWS


def test_lines_that_repeat_a_long_header_come_back_in_parts(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    seen = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, run, schema: seen.append(run) or df)
    html_blocks.blocks(spark.createDataFrame([], "key string, html string"))
    page = f"<table><tr><th>{'h' * 50_000}</th><th>x</th></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(2000)) + "</table>"
    largest = rows = 0
    tracemalloc.start()
    try:
        for out in seen[0](iter([pa.RecordBatch.from_pydict({"key": ["a"], "html": [page]})])):
            assert out.column("text")[0].as_py().endswith(f"h: {rows}") and set(out.column("kind").to_pylist()) == {"row"}
            largest, rows = max(largest, out.nbytes), rows + len(out)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000  # 100 MB of lines
    assert largest < 2 * batches.PIECE_BYTES and peak < 10 * batches.PIECE_BYTES


def test_sentences_of_many_texts_are_cut_in_pieces(monkeypatch):
    import pyarrow as pa

    taken = []
    monkeypatch.setattr(chunking, "sentence_chunks", lambda t, cut=chunking.sentence_chunks: taken.append(len(t)) or cut(t))
    texts = [f"Text {i} ends here. " * 100 if i % 7 else None for i in range(2000)]
    outs, before = [], 0
    for out in html_blocks._sentences.func(iter([pa.array(texts[:1500]), pa.array([], pa.string()), pa.array(texts[1500:])])):
        assert sum(taken[before:]) <= batches.PIECE_BYTES
        outs, before = outs + out.to_pylist(), len(taken)
    assert outs == [chunking.sentence_chunks(t or "") for t in texts] and sum(taken[:before]) > 3 * batches.PIECE_BYTES


def test_sentences_stay_with_their_texts(spark):
    texts = [f"Text {i} ends here. " * 60 if i % 7 else None for i in range(3000)]
    got = spark.createDataFrame(list(enumerate(texts)), "key int, text string").coalesce(1).select("key", html_blocks._sentences("text").alias("pieces")).collect()
    assert {r["key"]: r["pieces"] for r in got} == {i: chunking.sentence_chunks(t or "") for i, t in enumerate(texts)}


def test_paged_documents_are_read_once(spark, tmp_path):
    from folio.plans import store_queries

    spark.range(400).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 + 1 AS int) AS l_linenumber", "id AS l_partkey", "id * 3 AS l_suppkey", "1.0D AS l_extendedprice", "300 AS l_quantity", "'N' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id AS o_orderkey", "if(id % 2 = 0, 'F', 'O') AS o_orderstatus", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    got, rows = moved(spark, lambda: store_queries.paged_documents(spark, str(tmp_path)).collect())
    assert len(got) == 100 and rows < 3 * 400  # lines, then lines, tables and figures


def test_many_terms_leave_words_where_they_are(spark, monkeypatch):
    for name, value in (("BROADCAST_BYTES", 20 * 102), ("BROADCAST_TERMS", 20)):  # the earlier code counted terms
        monkeypatch.setattr(entities, name, value, raising=False)
    word = lambda n: "TERM" + chr(65 + n // 26) + chr(65 + n % 26)
    docs = spark.createDataFrame([(k, " ".join(word((i * 7 + k) % 60) + f" other{k}x{i}" for i in range(60))) for k in range(40)], "key long, text string")
    terms = spark.createDataFrame([(word(n), n) for n in range(60)], "term string, key long")
    got, rows = moved(spark, lambda: entities.links_in_text(docs, terms, 5).collect())
    want = {(k, n + 1, word(t), t) for k in range(40) for n, t in enumerate([t for t in ((i * 7 + k) % 60 for i in range(60)) if t != k][:5])}
    assert {tuple(r) for r in got} == want and len(got) == 200
    assert rows < 40 * 120 / 2  # words of the documents
