"""Operator 1: language identification.

Sparse multinomial logistic regression on TF-IDF weighted, hashed character n-grams. The weights are learned by
follow-the-regularised-leader with elastic-net penalties (FTRL-proximal), which leaves most of them at zero; a
temperature fitted on rows kept out of the training makes the probabilities honest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import bucket_of, give_back, small_batches, small_enough
from folio.llm.ngrams import code_points, gram_hashes, is_letter

BITS, SIZES = 16, (1, 2, 3)
#: Bound on the labelled rows that the classifier is fitted on, for each label; document frequencies count all of them.
ROWS_PER_LABEL = 800
#: Labels whose counts are broadcast at most; more of them meet the rows by shuffle.
BROADCAST_LABELS = 100_000


@dataclass
class Model:
    """``table`` holds idf times weight of each hashed n-gram and label."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    nonzero: float = 0.0
    stats: dict = field(default_factory=dict)


def features(text: str | None) -> np.ndarray | None:
    """The hashed n-grams of a text, one entry for each occurrence; None without letters.

    Letters are lower-cased and everything else becomes one gap.
    """
    if not text:
        return None
    cp = code_points(text.lower())
    letter = is_letter(cp)
    if not letter.any():
        return None
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cp = np.concatenate(([np.uint32(32)], cp[keep], [np.uint32(32)]))
    return np.concatenate(gram_hashes(cp, SIZES, BITS))


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


SCALE = 20.0


def vector(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF of n-gram occurrences: relative frequency times idf."""
    ids, counts = np.unique(h, return_counts=True)
    return ids, counts * (SCALE / len(h)) * idf[ids]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2**BITS, labels) and bias, one row at a time in a seeded order."""
    size = (1 << BITS) + 1  # the last one is the bias
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))
    order = np.random.default_rng(seed)

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            ids, x, y = rows[k]
            ids, x = np.append(ids, size - 1), np.append(x, 1.0)
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            g = probabilities(x @ w)
            g[y] -= 1.0
            g = x[:, None] * g[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by a fine grid: the loss is smooth and has one minimum."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 120)), key=loss))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all the documents each hashed n-gram occurs, and the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for b in batches:
            for t in b["text"]:
                n += 1
                if (h := features(t)) is not None:
                    seen = np.zeros((1 << BITS) + 1, bool)
                    seen[h] = True
                    df += seen
        df[-1] = n
        give_back()
        at = np.flatnonzero(df)
        yield pd.DataFrame({"gram": at, "n": df[at]})

    got = docs.select(F.col(text).alias("text")).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return df[:-1], int(df[-1])


def bounded_sample(rows: DataFrame, label: str, per_label: int, key: Column) -> DataFrame:
    """At most ``per_label`` rows of each label, those of least hash; all rows of a label that has no more.

    Rows are drawn where they lie, by their label's count; what is drawn is about what is kept, however frequent a label is.
    """
    counts = rows.groupBy(label).agg((1.5 * per_label / F.count("*")).alias("_share")).withColumnRenamed(label, "_label")
    if small_enough(counts, BROADCAST_LABELS):
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    drawn = rows.withColumn("_draw", draw).join(counts, F.col(label) == F.col("_label")).filter("_draw < _share")
    place = F.row_number().over(W.partitionBy(label).orderBy("_draw", key))
    return drawn.withColumn("_place", place).filter(F.col("_place") <= per_label).drop("_draw", "_label", "_share", "_place")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = ROWS_PER_LABEL) -> Model:
    """Learn from all rows of ``docs`` with a label; without any, the model knows no language."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 0.1

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, t in zip(b["lang"], b["text"], strict=True):
                if (h := features(t)) is not None:
                    ids, counts = np.unique(h, return_counts=True)
                    yield pd.DataFrame({"lang": [lang], "ids": [ids.astype(np.int32).tobytes()], "counts": [counts.astype(np.int32).tobytes()]})

    got = bounded_sample(rows, "lang", per_label, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).select("lang", "text").mapInPandas(vectors, "lang string, ids binary, counts binary").toPandas()
    labels = sorted(got["lang"].unique())
    if not labels:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    place = {x: i for i, x in enumerate(labels)}
    data = []
    for lang, ids, counts in got.itertuples(index=False):
        ids, counts = np.frombuffer(ids, np.int32).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.float64)
        data.append((ids, counts * (SCALE / counts.sum()) * idf[ids], place[lang]))
    held = [r for i, r in enumerate(data) if i % 5 == 4]
    w, bias = ftrl([r for i, r in enumerate(data) if i % 5 != 4] or data, len(labels))
    logits = np.array([x @ w[ids] + bias for ids, x, _ in held]).reshape(len(held), len(labels))
    y = np.array([r[2] for r in held], np.int64)
    return Model(labels, (w * idf[:, None] * SCALE).astype(np.float32), bias, fit_temperature(logits, y), float((w != 0).mean()), {"rows": len(data), "held": float((logits.argmax(1) == y).mean()) if len(y) else None})


def predict(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the columns ``out``: the language, and its calibrated probability. Columns of these names are replaced.

    A null text, or one without a letter, gets ``und`` and 0.0, and so does every text of a model without labels. The whole
    text is read, however long. All other columns and repeated rows pass through.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of a number for each label

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for t in texts:
            h = features(t) if m.labels else None
            if h is None:
                out.append(("und", 0.0))
                continue
            total = np.zeros(len(m.labels))
            for i in range(0, len(h), 65536):
                total += m.table[h[i : i + 65536]].sum(0, dtype=np.float64)
            p = probabilities((total / len(h) + m.bias) / m.temperature)
            k = int(p.argmax())
            out.append((m.labels[k], float(min(1.0, p[k]))))
        give_back()
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    named = docs.withColumn("_folio_judged", judge(F.col(text)))
    return named.withColumns({out[0]: F.col("_folio_judged.lang_pred"), out[1]: F.col("_folio_judged.score")}).drop("_folio_judged")


def report(docs: DataFrame) -> DataFrame:
    """Learn where crc32(doc_id) mod 4 is not 2; predict everywhere from the text alone."""
    held = bucket_of(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
