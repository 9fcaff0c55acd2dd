"""A training corpus from ``documents``: known languages, one of each near-duplicate class, no benchmark text, no secrets, tokens.

Each stage takes the documents that the one before kept, works on all of them, and returns those it keeps; the last
returns the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, decontam, langid, neardup, secrets
from folio.llm.common import materialize, small_batches, table

#: Documents in which no language is as likely as this are rejected, along with those without letters.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language. The model learns from those that are labelled; a missing label is filled in.

    Null, empty and letterless texts go; without a single label all go. Repeated rows stay; further columns pass through.
    """
    out = ("_folio_lang", "_folio_score")
    judged = langid.predict(docs, langid.train(docs), out=out)
    kept = judged.filter((F.col(out[0]) != "und") & (F.col(out[1]) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", out[0])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class, the one of least doc_id; of repeated rows one. Null texts are no copies of others."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or a shorter item whole. Texts without words stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret; documents without any, and null texts, stay as they are."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, token_ids, n_tokens, and whether decoding gives the text back. A null text is empty."""
    import public_tokenizers

    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_checked(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "n_chars"])
    return coded.select("doc_id", "lang", "source", "n_chars", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", tokenize),
]

#: SQL can't express the trained and sampled stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
