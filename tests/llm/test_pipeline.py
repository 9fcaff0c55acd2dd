"""Each stage of the pipeline against what its operator's brute force says of the stage's input."""

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import bpe, decontam, neardup, secrets
from folio.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name.split()[0]))
    return out


def test_stages_keep_the_columns(staged):
    assert [n for n, _ in corpus_pipeline.STAGES][:1] == ["language ID"] and len(corpus_pipeline.STAGES) == 5
    assert all(d.columns == staged[0].columns for d in staged[1:-1])


def test_language_stage_keeps_prose(staged):
    lost = staged[0].join(staged[1], "doc_id", "left_anti")
    assert lost.filter(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) > 40).count() == 0
    assert staged[1].filter("text IS NULL OR text = ''").count() == 0


def test_one_of_each_class_stays(staged):
    kept = {r["doc_id"] for r in staged[2].collect()}
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(staged[1]).collect()}
    assert kept == set(classes.values())


def test_no_benchmark_window_is_left(staged):
    con = duckdb.connect()
    before, after = staged[2].toPandas(), staged[3].toPandas()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.register("documents", before)
    hit = {r[0] for r in con.sql(decontam.SQL).select("doc_id, contaminated").fetchall() if r[1]}
    assert hit and set(after["doc_id"]) == set(before["doc_id"]) - hit


def test_secrets_are_gone(spark, staged):
    assert staged[4].count() == staged[3].count()
    con = duckdb.connect()
    con.register("documents", staged[4].toPandas())
    assert con.sql(secrets.SQL).filter("spans <> ''").fetchall() == []
    same = staged[3].join(staged[4].select("doc_id", F.col("text").alias("new"), F.col("n_chars").alias("n")), "doc_id")
    assert same.filter("n <> length(new)").count() == 0 and same.filter("text <> new AND NOT contains(new, '[secret]')").count() == 0


def test_tokens(staged):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in staged[4].collect()}
    got = staged[5].collect()
    assert len(got) == len(texts) and all(r["round_trip"] and r["token_ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) for r in got)


def test_stages_take_odd_rows_and_columns_of_any_name(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, lang_pred string, key string, text_key long"
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None, None, None, "a", "b", "c", "d", 1), (2, "", "en", "s", 0, "a", "b", "c", "d", 1), (3, "password = hunter2hunter2 and " + words, "en", "s", None, "a", "b", "c", "d", 1)]
    rows += [rows[2], (None, "plain prose without a number", "en", None, 28, None, None, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                kept = {(r["spans"], r["score"], r["lang_pred"], r["key"], r["text_key"]) for r in out.collect()}
                assert kept <= {("a", "b", "c", "d", 1), (None,) * 5}
            assert out.count() <= docs.count()
    docs = spark.createDataFrame(rows, schema)
    assert corpus_pipeline.redact_secrets(spark, docs, SF).count() == 5 and corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() == 4
    assert [r["n_tokens"] for r in corpus_pipeline.tokenize(spark, docs, SF).collect()][:2] == [0, 0]
