"""Operator 7: a quality classifier over supervised subword embeddings.

Each word and each character n-gram within a word has a learned vector, found by hashing. A document is the mean
of its vectors; a softmax over a linear layer gives the classes. Both are trained by stochastic gradient descent.
As the mean is linear, scoring needs only the product of each vector with the linear layer, a table of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bucket_of, small_batches
from folio.llm.langid import bounded_sample, probabilities
from folio.llm.ngrams import code_points, gram_hashes, powers

BITS, SIZES, DIM = 17, (3, 4, 5), 12
#: A word that returns within so many words has, beside its own vectors, so many learned ones for the distance (a word has
#: about as many n-grams). They stand behind the hashed ones.
NEAR, AGAIN = 12, 6
ROWS = (1 << BITS) + 3 * AGAIN
#: Bound on the labelled rows that the classifier is fitted on, for each class.
ROWS_PER_CLASS = 1200
_MULT = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    classes: list[int]
    table: np.ndarray
    bias: np.ndarray


def features(text: str | None) -> np.ndarray:
    """Hashes of the words and of their 3- to 5-grams, white space standing for a word's ends; one for each occurrence."""
    if not text or not text.strip():
        return np.empty(0, np.int64)
    cp = code_points(f" {text} ")
    gap = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0xA0)
    cp = np.where(gap, np.uint32(32), cp)
    out = []
    for n, h in zip(SIZES, gram_hashes(cp, SIZES, BITS), strict=False):
        inner = np.zeros(len(h), bool)  # white space between the first and the last character
        for i in range(1, n - 1):
            inner |= gap[i : i + len(h)]
        inner |= gap[: len(h)] & gap[n - 1 : n - 1 + len(h)]
        out.append(h[~inner])
    starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    if len(starts):
        length = ends - starts
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        letters = cp[~gap].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(letters * powers(int(length.max()))[place], np.cumsum(length) - length)
        out.append(((sums * _MULT) >> np.uint64(64 - BITS)).astype(np.int64))
        # a word that came shortly before has the vectors of a word of their own, by its distance
        long, since = length >= 4, np.zeros(len(sums), np.int64)
        for lag in range(min(NEAR, len(sums) - 1), 0, -1):
            since[lag:][sums[lag:] == sums[:-lag]] = lag
        since[(since > 1) & ~long] = 0
        kind = np.searchsorted((1, 4, NEAR), since[since > 0])
        out.append((1 << BITS) + (kind[:, None] * AGAIN + np.arange(AGAIN)[None, :]).ravel())
    return np.concatenate(out)


def sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 6, rate: float = 0.8, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, layer, bias) after plain SGD with a linearly falling rate, in a seeded order."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    layer, bias = np.zeros((n_classes, DIM), np.float32), np.zeros(n_classes, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, share, y = rows[k]
            lr = rate * (1 - done / steps)
            done += 1
            v = vec[ids]
            mean = share @ v  # nothing, and so the bias alone, for a text without words
            err = -probabilities(layer @ mean + bias)
            err[y] += 1.0
            back = err @ layer
            layer += lr * err[:, None] * mean[None, :]
            bias += lr * 0.1 * err
            vec[ids] = v + (lr * min(len(ids), 200)) * share[:, None] * back[None, :]
    return vec, layer, bias


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = ROWS_PER_CLASS) -> Model:
    """Learn from the texts of (doc_id, label) rows; without any, the model has no classes.

    The labels are sampled before they meet the texts: at most ``per_class`` times the classes are joined, by broadcast.
    Texts of other rows are not shuffled.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label")).filter("label IS NOT NULL AND _id IS NOT NULL")
    marks = bounded_sample(marks, "label", per_class, F.col("_id").cast("string"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(marks), "_id")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, y, t in zip(b["_id"], b["label"], b["text"], strict=True):
                ids, counts = np.unique(features(t), return_counts=True)
                yield pd.DataFrame({"id": [str(i)], "label": [y], "ids": [ids.astype(np.int32).tobytes()], "counts": [counts.astype(np.int32).tobytes()]})

    got = rows.select("_id", "label", "text").mapInPandas(vectors, "id string, label int, ids binary, counts binary").toPandas()
    classes = sorted(int(x) for x in got["label"].unique())
    if not classes:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0))
    data = []
    for y, ids, counts in got.sort_values(["id", "ids"])[["label", "ids", "counts"]].itertuples(index=False):
        counts = np.frombuffer(counts, np.int32).astype(np.float32)
        data.append((np.frombuffer(ids, np.int32), counts / max(1.0, counts.sum()), classes.index(y)))
    vec, layer, bias = sgd(data, len(classes))
    return Model(classes, (vec @ layer.T).astype(np.float32), bias)


def score(docs: DataFrame, model: Model, text: str = "text", positive: int = 1) -> DataFrame:
    """``docs`` with score, the probability of class ``positive``, and predicted (1 from one half on, else 0).

    A null or empty text, or one of white space, has no vectors: the softmax of the bias is its score. A model without
    labels gives 0.5. Whole texts are read; other columns and repeated rows pass through.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS rows of one number for each class

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        at = m.classes.index(positive) if positive in m.classes else -1
        for t in texts:
            h = features(t)
            if at < 0:
                out.append(0.0 if m.classes else 0.5)
            else:
                total = sum(m.table[h[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(h), 65536))
                out.append(float(min(1.0, probabilities(total / max(len(h), 1) + m.bias)[at])))
        return pd.Series(out, dtype=float)

    return docs.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of rows where crc32(doc_id) mod 3 is not 1; score everywhere from the text alone.

    Where an id has several labels the greatest counts.
    """
    held = bucket_of(F.col("doc_id"), 3) == 1
    marks = labels.filter(~held).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = train(docs, marks)
    return score(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
