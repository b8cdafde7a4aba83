"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of byte n-grams (2 to 4 bytes, hashed into 2**BITS
places) that both have, divided by the root of the product of how many each has. Kernel ridge regression, one
language against the rest, is fitted in the space that Nyström landmarks span. Because this kernel is an inner
product of presence vectors, landmarks and ridge weights multiply out to one matrix (places x languages), and a
batch of texts is scored by one matrix product with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BITS = 15
ORDERS = (2, 3, 4)
ROWS = 64
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def presence(text: str, out: np.ndarray) -> None:
    """Mark in out the n-grams of the lower-cased text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    word = data[:-1] << 8 | data[1:] if len(data) > 1 else data[:0]
    for n, mix in zip(ORDERS, MIX, strict=True):
        if n > 2:
            if len(data) < n:
                break
            word = word[: len(data) - n + 1] << 8 | data[n - 1 :]
        out[word * np.uint32(mix) >> np.uint32(32 - BITS)] = 1


def matrix(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, text in zip(out, texts, strict=True):
        presence(text, row)
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # places x languages


def fit(texts: list[str], languages: list[str], landmarks: int = 256, ridge: float = 0.1, seed: int = 7) -> Model:
    """Kernel ridge regression on Nyström features; the landmarks are drawn evenly from every language."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    rng = np.random.default_rng(seed)
    by = [rng.permutation([i for i, x in enumerate(languages) if x == name]) for name in names]
    chosen = sorted(int(i) for own in by for i in own[: max(1, landmarks // len(names))])
    base = scaled(matrix([texts[i] for i in chosen]))
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram = np.zeros((root.shape[1] + 1,) * 2)
    right = np.zeros((root.shape[1] + 1, len(names)))
    for at in range(0, len(texts), ROWS):
        own = scaled(matrix(texts[at : at + ROWS])) @ base.T @ root
        own = np.hstack([own, np.ones((len(own), 1))])
        target = np.array([[1.0 if x == name else -1.0 for name in names] for x in languages[at : at + ROWS]])
        gram += own.T @ own
        right += own.T @ target
    penalty = ridge * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(gram + penalty, right)
    weights = base.T @ (root @ solved[:-1])
    # the constant is spread as a last row
    return Model(names, np.vstack([weights, solved[-1:]]).astype(np.float32))


def fold(doc_id: str = "doc_id"):
    """Null for a null id, which has no fold and is neither learned from nor held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, train_rows: int = 3000, landmarks: int = 256) -> Model:
    """Fit on about ``train_rows`` rows outside fold 2, as many of each language as of the others at most.

    Rows of a language are those whose hashed ids are below its own bound, so nothing is ranked and the sample is
    bounded. Languages come from a table that has as many rows as there are languages.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    each = train_rows / len(counts)
    scale = 1 << 40
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, int(min(1.0, each / n) * scale)))])
    rows = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(scale)) < bound[F.col("lang")])
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in rows.select("doc_id", "lang", "text").collect())
    return fit([r[2] for r in rows], [r[1] for r in rows], landmarks)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, which replace columns of docs that have these names.

    Null texts and texts without a letter are ``und`` with score 0. Every row, with a repeated or null id or not, is
    judged by itself and from its text alone. An empty table gives no rows.

    ``score`` is the place of the best output between -1 (0) and 1 (1). If nothing could be learned every text is
    ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows x languages

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, weights = shared.value
        linear, constant = weights[: 1 << BITS], weights[1 << BITS :]
        for texts in batches:
            texts = [x if isinstance(x, str) and any(map(str.isalpha, x)) else None for x in texts]
            preds = np.full(len(texts), "und", dtype=object)
            scores = np.zeros(len(texts))
            if names:
                for at in range(0, len(texts), ROWS):
                    own = [k for k in range(at, min(at + ROWS, len(texts))) if texts[k] is not None]
                    if not own:
                        continue
                    out = scaled(matrix([texts[k] for k in own])) @ linear + constant
                    top = out.argmax(axis=1)
                    preds[own] = [names[k] for k in top]
                    scores[own] = np.clip((out.max(axis=1) + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": preds, "score": scores})

    rows = docs.drop("lang_pred", "score").select(F.struct("*").alias("row"), best("text").alias("best"))
    return rows.select("row.*", "best.lang_pred", "best.score")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of documents; rows with a null id are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
