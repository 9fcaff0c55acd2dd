"""Scalar functions against literal cases."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import chunking as C
from folio.functions import text as X
from folio.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (X.ascii_fold, "l’eau cœur Éléphant ½ … ﬁn", "leau cur Elephant 12 ... fin"),
        (X.slug, "Doliprane 500 mg, comprimé", "doliprane-500-mg-comprime"),
        (X.slug, "---", "rcp"),
        (X.slug, "a" * 79 + " b", "a" * 79 + "-"),
        (X.browse_letter, "5-FLUORO", "F"),
        (X.browse_letter, "12", "#"),
        (X.collapse, " a \u00a0 b\n", "a b"),
        (X.same_length_fold, "éàç œß", "EAC œß"),
        (X.search_fold, "Éa œ", "ea œ"),
        (X.repair_cp1252, "l\x92eau \x85\x81", "l’eau …"),
        (X.brand_root, "ABILIFY 10 mg, tablet", "ABILIFY"),
        (X.brand_root, "5 FU", "5 FU"),
        (X.clean_substance, "RANITIDINE (CHLORHYDRATE DE)", "RANITIDINE"),
        (X.clean_substance, "AMOXICILLINE TRIHYDRATEE", "AMOXICILLINE"),
        (X.clean_substance, "ACIDE CLAVULANIQUE", "ACIDE CLAVULANIQUE"),
        (X.clean_substance, "SULFATE DE MAGNESIUM", "SULFATE DE MAGNESIUM"),
        (X.html_escape, '<a & "b">', "&lt;a &amp; &quot;b&quot;&gt;"),
        (X.first_dmy_date, "mis à jour le 05/03/2024.", "2024-03-05"),
        (X.first_dmy_date, "31/02/2024", ""),
        (X.packed_date, "D:20241399", "2024-13-99"),
        (X.long_date, "2024-08-01", "1er août 2024"),
        (X.is_filler, "Sans objet.", True),
        (X.is_filler, "[à compléter ultérieurement par le titulaire]", True),
        (X.is_filler, "Trois mots ici.", False),
        (X.tokens, "Cœur l’eau 500mg 500MG", ["CUR", "LEAU", "500MG"]),
        (X.query_terms, "Quels effets dans le foie, Effets", ["effets", "foie"]),
        (X.heading_level, "x AmmAnnexeTitre2", 2),
        (X.heading_level, "none", None),
        (X.eu_number, "a EU/1/04/276 b", "EU/1/04/276"),
        (X.last_modified, "2024-01-02T03:04", "2024-01-02"),
        (X.json_for_script, "a<b", "a\\u003cb"),
    ],
)
def test_text(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_a_paragraph_is_folded_once_to_judge_it(spark):
    df = spark.createDataFrame([(None,), ("",), (" \u00a0",), ("aa bb",), ("deux mots",), ("  SANS\u00a0objet : ",), ("À compléter  ultérieurement par lui",), ("sans objet pour eux",)], "c string")
    got = df.select("c", X.is_filler(F.col("c")).alias("r"))
    assert [r["r"] for r in got.collect()] == [True] * 7 + [False]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(c") == 1 and plan.count("translate(") == 1


def test_hash_is_parted_by_nul(spark):
    import hashlib

    assert one(spark, X.content_hash, "x") == hashlib.sha256(b"6\0x").hexdigest()[:16]


def test_pdf_signature(spark):
    assert one(spark, X.looks_like_pdf, b"%PDF-1.7", "binary") is True
    assert one(spark, X.looks_like_pdf, b"<html>", "binary") is False


def test_duration(spark):
    assert one(spark, X.hms, 3725, "long") == "1:02:05"


def test_quantize_rounds_half_to_even_and_clamps(spark):
    got = one(spark, V.quantize, [0.5 / 127, 1.5 / 127, -2.0, 1.0], "array<double>")
    assert got == [0, 2, -127, 127]


def test_normalize(spark):
    got = one(spark, lambda c: V.truncate_and_normalize(c, 2), [3.0, 4.0, 9.0], "array<double>")
    assert got == pytest.approx([0.6, 0.8])
    assert one(spark, lambda c: V.truncate_and_normalize(c, 2), [0.0, 0.0], "array<double>") == [0.0, 0.0]


@given(st.text(alphabet="ab. !?\n", max_size=400), st.integers(3, 40))
def test_sentence_chunks_lose_nothing(text, limit):
    chunks = C.sentence_chunks(text, limit)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(c) <= limit for c in chunks)


def test_chunk_boundaries():
    a = "x" * 248 + "."
    assert C.sentence_chunks(f"{a} {a}") == [f"{a} {a}"]  # 499
    assert len(C.sentence_chunks(f"{a} {a}b.")) == 2  # 501


def test_table_lines():
    rows = [["Population", "Dose", ""], ["Adulte", "500 mg", "x"], ["", "", ""], ["Enfant", "", ""]]
    assert C.table_lines(rows) == ["Population: Adulte; Dose: 500 mg; x", "Population: Enfant"]
    assert C.table_lines([["a"], ["b"]]) == []
    assert C.table_lines([["", ""], ["b", "c"]]) == []


def test_table_lines_keep_every_row():
    rows = [["Dose", "Effet"], *([f"{i} mg", "" if i % 3 else "aucun"] for i in range(1000))]
    assert C.table_lines(rows) == [f"Dose: {i} mg" + ("" if i % 3 else "; Effet: aucun") for i in range(1000)]
    assert C.table_lines([["a", "b"], ["", ""]]) == []
