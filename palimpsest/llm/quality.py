"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text becomes tokens: lower-cased words, marks, and for every word its shape (upper case, capitalised, lower case,
with digits). Unigrams, bigrams and the bigram "same word twice" are hashed into 2**BITS weights. A feature's value
is the square root of its share of all n-grams; one constant stands beside them. Scores are sparse dot products of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BITS = 18
CONSTANT = 1 << BITS  # beside the hashed places
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_TOKENS = 500_000
SAME = np.uint64(0x53414D45)
MIX = np.uint64(0x9E3779B97F4A7C15)
MARK = np.uint64(xxhash.xxh64_intdigest("mark", 1))


def shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return "mark"
    if not token.isalpha():
        return "digits"
    if token.isupper() and len(token) > 1:
        return "upper"
    return "capital" if token[0].isupper() else "lower"


class Features:
    """indices, values of a text."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hashes = np.zeros((1024, 2), np.uint64)

    def learn(self, tokens: set[str]) -> None:
        if len(self.number) > CACHE_TOKENS:
            self.__init__()
        start = len(self.number)
        new = [x for x in tokens if x not in self.number]
        while start + len(new) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        for k, token in enumerate(new, start):
            self.number[token] = k
            self.hashes[k] = xxhash.xxh64_intdigest(token.lower()), xxhash.xxh64_intdigest(shape(token), 1)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return np.full(1, CONSTANT), np.full(1, 0.5)
        distinct = set(tokens)
        if not distinct <= self.number.keys():
            self.learn(distinct)
        both = self.hashes[list(map(self.number.__getitem__, tokens))]
        word, form = both[:, 0], both[:, 1]
        pairs = word[:-1] * MIX + word[1:]
        forms = form[:-1] * MIX + form[1:]
        plain = word[form != MARK]
        same = np.full(int((plain[:-1] == plain[1:]).sum()), SAME)
        every = np.concatenate([word, form, pairs, forms, same]) * MIX >> np.uint64(64 - BITS)
        indices, counts = np.unique(every.astype(np.int64), return_counts=True)
        return np.append(indices, CONSTANT), np.append(np.sqrt(counts / len(every)), 0.5)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train_ftrl(
    rows: list[tuple[str, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.01, epochs: int = 6, seed: int = 7
) -> np.ndarray:
    """Weights after passes over the rows in shuffled orders; per-coordinate step sizes, L1 keeps rare ones at 0."""
    features, pieces, bounds = Features(), [], [0]
    for k in range(0, len(rows), 500):  # few large arrays: the driver's memory is given back when they go
        found = [features(text) for text, _ in rows[k : k + 500]]
        bounds += (bounds[-1] + np.cumsum([len(i) for i, _ in found])).tolist()
        pieces.append((np.concatenate([i for i, _ in found]).astype(np.int32), np.concatenate([x for _, x in found])))
    places, values = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (None, None)
    del pieces, features
    z = np.zeros(CONSTANT + 1)
    n = np.zeros(CONSTANT + 1)
    order = np.random.default_rng(seed)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            own = slice(bounds[k], bounds[k + 1])
            i, x, label = places[own], values[own], rows[k][1]
            w = weights(i)
            g = (sigmoid(w @ x) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(CONSTANT + 1)).astype(np.float32)


def fold(doc_id: str = "doc_id"):
    """Null for a null id, which has no fold and is neither learned from nor held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


#: A hash modulo this picks samples; no share of rows is too small for it.
SCALE = 1 << 40


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> np.ndarray:
    """Fit on a sample of about ``train_rows`` labelled rows outside fold 1: those whose hashed ids are below a bound.

    The sample is bounded whatever the size of the corpus, and the order of its rows is fixed by doc_id. Labels that
    are null, or that contradict each other for one doc_id, are left out; equal ones count once, and every row of a
    repeated doc_id is learned from. With no labels, or empty tables, all scores are 0.5.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 1)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most"))
    known = known.where("label = _most")
    total = known.count()
    share = min(1.0, train_rows / max(1, total))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(SCALE)) < max(1, int(share * SCALE)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known.select("doc_id", "label")), "doc_id").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train_ftrl([(r["text"], int(r["label"] > 0)) for r in rows])


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """docs with ``score`` and ``predicted``, which replace columns of docs that have these names.

    Empty and null texts have no feature but the constant. Every row, with a repeated or null id or not, is scored by
    itself and from its text alone. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats whatever the input

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, w = Features(), shared.value
        for texts in batches:
            found = (features(x or "") for x in texts)
            yield pd.Series([sigmoid(float(w[i].astype(np.float64) @ x)) for i, x in found], dtype="float64")

    scored = docs.withColumn("score", quality(F.coalesce("text", F.lit(""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of documents; rows with a null id are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, weights).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
