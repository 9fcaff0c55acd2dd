"""The driver's contract, and the catalog queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from folio.plans import catalog_queries, page_queries, store_queries, value_queries

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


QUERIES = catalog_queries.QUERIES | page_queries.QUERIES | value_queries.QUERIES | store_queries.QUERIES
ORACLE_SQL = catalog_queries.ORACLE_SQL | page_queries.ORACLE_SQL | value_queries.ORACLE_SQL | store_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    a = sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=str)
    b = sorted((tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall()), key=str)
    assert a == b


def test_queries_over_all_documents(spark, tmp_path):
    docs = [(1, "Únder the thered élève"), (2, "under eleve"), (3, None), (4, "Übung, über")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["token"]: r["n_docs"] for r in catalog_queries.QUERIES["token_frequency"](spark, str(tmp_path)).collect()}
    assert got == {"UNDER": 2, "THE": 1, "THERED": 1, "ELEVE": 2, "UBUNG": 1, "UBER": 1}
    got = {r["doc_id"]: r["lexical"] for r in catalog_queries.QUERIES["word_credit"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.666667, 2: 0.333333, 3: 0.0, 4: 0.0}
