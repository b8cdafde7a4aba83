"""Searching by vectors of occurrences: every token of a sentence has a vector of its own, made by an encoder one supplies.

An encoder is a function from a list of token lists to a list of arrays (layers x tokens x dimensions). The store is a
table (doc_id, sentence_id, variant, n_tokens, max_len_s, vectors) in Parquet. Similarities are raw dot products, without
weights by part of speech and without a threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import align
from palimpsest.plans import search as S

Encoder = Callable[[list[list[str]]], list[np.ndarray]]
NEEDLE_NUMBERS = 4_000_000
AT_ONCE = 1024
BLOCK = 6_000_000


def layer_mean(layers: np.ndarray) -> np.ndarray:
    """Mean over the layers, each token's vector at length 1; zero vectors stay."""
    mean = np.asarray(layers, dtype=np.float64).mean(axis=0)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.divide(mean, length, out=np.zeros_like(mean), where=length > 0)


def encoded(rows: DataFrame, encoder: Encoder, variants: int = 1) -> DataFrame:
    """rows(..., tokens) with variant and vectors (array<array<double>>), one row for each variant; no shuffle."""
    kept = [f for f in rows.schema if f.name != "tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for variant in range(variants):
                found = encoder([list(x) for x in batch["tokens"]])
                yield batch[[f.name for f in kept]].assign(variant=variant, vectors=[list(layer_mean(x)) for x in found])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept])
    return rows.mapInPandas(run, schema + ", variant int, vectors array<array<double>>")


def build(sentences: DataFrame, encoder: Encoder, path: str, variants: int = 1) -> None:
    """Write the store of a corpus, once; a store that is there stays."""
    rows = sentences.select("doc_id", "sentence_id", "n_tokens", "max_len_s", "tokens")
    encoded(rows, encoder, variants).write.mode("ignore").parquet(path)


def best_variant(found: DataFrame) -> DataFrame:
    """Of the variants of a sentence the one with the greatest score, the first of equal ones."""
    keys = ["query_id", "doc_id", "sentence_id"]
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "variant")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


SCORES = "metric_no int, query_id long, doc_id long, sentence_id int, variant int, score double"
TRACED = SCORES + ", place int, match array<int>, similarities array<double>"


def _needles(needles: DataFrame) -> dict[int, np.ndarray]:
    """needles(query_id, vectors) go to every executor: they are texts that someone asked for; too many numbers are refused."""
    asked = {r["query_id"]: np.array(r["vectors"]) for r in needles.select("query_id", "vectors").collect() if r["vectors"]}
    if sum(v.size for v in asked.values()) > NEEDLE_NUMBERS:
        raise ValueError("too many needles for one search: ask for them in parts")
    return asked


def scores(store: DataFrame, asked: dict[int, np.ndarray], options: S.Options) -> DataFrame:
    """The score of every sentence and variant for every needle, where it is above the least one."""
    shared = store.sparkSession.sparkContext.broadcast(asked)  # NEEDLE_NUMBERS at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            sizes = batch["vectors"].map(len).to_numpy()
            for n in np.unique(sizes[sizes > 0]):
                for rows in np.array_split(batch.iloc[np.flatnonzero(sizes == n)], -(-int((sizes == n).sum()) // AT_ONCE)):
                    own = np.stack([np.stack(v) for v in rows["vectors"]])
                    for query, needle in shared.value.items():
                        score = _scored(own @ needle.T, rows["max_len_s"].to_numpy(), float(len(needle)), options)
                        kept = np.flatnonzero(score > options.min_score)
                        told = rows.iloc[kept]
                        out.extend(zip(*[[c] * len(kept) for c in (0, query)], told["doc_id"], told["sentence_id"], told["variant"], score[kept].tolist(), strict=True))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORES.split(", ")])

    return store.select("doc_id", "sentence_id", "variant", "max_len_s", "vectors").mapInPandas(run, SCORES)


def _costs(near: np.ndarray, longest: np.ndarray, options: S.Options) -> np.ndarray:
    kinds, which = np.unique(longest, return_inverse=True)
    return np.stack([align.gap_costs(max(near.shape[1:]) + 1, options.cutoff, m) for m in kinds])[which]


def _scored(near: np.ndarray, longest: np.ndarray, total: float, options: S.Options) -> np.ndarray:
    """Scores of sentences of one length."""
    costs, lengths = _costs(near, longest, options), np.full(len(near), near.shape[1])
    if options.submatch_weight:
        return np.array([_traced(near[k : k + 1], costs[k : k + 1], total, options)[0] for k in range(len(near))])
    raw = align.raw_scores(near, lengths, costs)
    if options.bidirectional:
        raw = np.maximum(raw, align.raw_scores(align.turned(near, lengths), lengths, costs))
    return raw / total


def _traced(near: np.ndarray, costs: np.ndarray, total: float, options: S.Options) -> tuple[float, list[int]]:
    both = align.align_both_ways if options.bidirectional else align.align
    raw, (match,) = both(near, np.array([near.shape[1]]), costs)
    return float(raw[0]) / align.reference_score(total, float(sum(u >= 0 for u in match)), options.submatch_weight), match


def traced(found: DataFrame, store: DataFrame, asked: dict[int, np.ndarray], options: S.Options) -> DataFrame:
    """found with match and similarities; only results come here."""
    rows = store.join(F.broadcast(found), ["doc_id", "sentence_id", "variant"])  # max_matches rows a needle at most
    shared = store.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                needle = shared.value[r.query_id]
                near = (np.stack(r.vectors) @ needle.T)[None]
                costs = align.gap_costs(max(near.shape) + 1, options.cutoff, r.max_len_s)[None]
                match = _traced(near, costs, float(len(needle)), options)[1]
                told = [float(near[0, u, v]) if u >= 0 else 0.0 for v, u in enumerate(match)]
                out.append((0, r.query_id, r.doc_id, r.sentence_id, r.variant, r.score, r.place, match, told))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TRACED.split(", ")])

    return rows.select("query_id", "doc_id", "sentence_id", "variant", "score", "place", "max_len_s", "vectors").mapInPandas(run, TRACED)


def search(store: DataFrame, queries: DataFrame, encoder: Encoder, options: S.Options = S.Options()) -> DataFrame:
    """queries(query_id, query) against a store: the best sentences of each, with place from 1."""
    tokens = queries.select("query_id", T.token_array(F.col("query")).alias("tokens"))
    asked = _needles(encoded(tokens, encoder))
    return traced(S.best(best_variant(scores(store, asked, options)), options), store, asked, options)


def alike(own: np.ndarray, needle: np.ndarray) -> np.ndarray:
    """Dot products, added up component by component: equal tokens have equal numbers, wherever they stand."""
    out = np.zeros((len(own), len(needle)))
    for k in range(needle.shape[1]):
        out += own[:, k, None] * needle[:, k]
    return out


class Occurrences(S.Scan):
    """A scan whose words are occurrences: each token has a row of its own in the table of its block."""

    def __init__(self, asked: dict[int, np.ndarray], encoder: Encoder, options: S.Options):
        at = np.cumsum([0, *(len(v) for v in asked.values())])
        needles = {q: (int(first), [1.0] * len(v)) for (q, v), first in zip(asked.items(), at, strict=False)}
        none = np.zeros((1, int(at[-1])))
        super().__init__(S.Table({}, none, none > 0, none, [None], needles), options)
        self.encoder = encoder
        self.vectors = np.concatenate([*asked.values()]) if asked else np.zeros((0, 1))
        self.tokens: list[list[str]] = []

    def needed(self, first: int, weights: list[float]):
        return lambda score: score * self.least * float(sum(weights)) if score > -np.inf else score

    def documents(self, ids: list, sentences: list) -> None:
        for k, own in zip(ids, sentences, strict=True):
            own = [list(tokens) for tokens in own]
            if not own:
                continue
            size = np.array([len(tokens) for tokens in own], np.int64)
            self.wait.append((k, size, np.arange(self.waiting + 1, self.waiting + size.sum() + 1)))
            self.tokens.extend(own)
            self.waiting += int(size.sum())
            if self.waiting * max(self.width, 2 * self.vectors.shape[1]) > BLOCK:
                self.block()

    def block(self) -> None:
        if self.wait and self.width:
            vectors = layer_mean(np.concatenate(self.encoder(self.tokens), axis=1))
            self.hold(np.concatenate([np.zeros((1, self.width)), alike(vectors, self.vectors)]))
            super().block()
            flat = [t for tokens in self.tokens for t in tokens]
            for kept in self.kept.values():
                kept[:] = [(*x[:6], [flat[t - 1] for t in x[6]], x[7]) if isinstance(x[6], np.ndarray) else x for x in kept]
        self.wait, self.waiting, self.tokens = [], 0, []


def search_documents(docs: DataFrame, queries: DataFrame, encoder: Encoder, options: S.Options = S.Options()) -> DataFrame:
    """As ``search``, on docs(doc_id, text): sentences are encoded where they are scored, and no vector leaves the task.

    The floor and the cap of a document hold in its row; each task lets out the best of each needle.
    """
    asked = _needles(encoded(queries.select("query_id", T.token_array(F.col("query")).alias("tokens")), encoder))
    shared = docs.sparkSession.sparkContext.broadcast(asked)  # NEEDLE_NUMBERS at most
    found_schema = S.FOUND.replace("tokens array<int>", "tokens array<string>")
    names = [x.split()[0] for x in found_schema.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Occurrences(shared.value, encoder, options)
        for batch in batches:
            own.documents([None if pd.isna(x) else int(x) for x in batch["doc_id"]], S.tokenised(batch))
        yield pd.DataFrame(list(own.found()), columns=names).astype({"doc_id": "Int64"})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                needle = shared.value[r.query_id]
                near = alike(layer_mean(encoder([list(r.tokens)])[0]), needle)[None]
                match = _traced(near, align.gap_costs(max(near.shape) + 1, options.cutoff, r.longest)[None], float(len(needle)), options)[1]
                told = [float(near[0, u, v]) if u >= 0 else 0.0 for v, u in enumerate(match)]
                out.append((0, r.query_id, r.doc_id, r.sentence_id, 0, r.score, r.place, match, told))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TRACED.split(", ")]).astype({"doc_id": "Int64"})

    found = S.with_tokens(docs).mapInPandas(scan, found_schema)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"), F.desc("sentence_id")))
    return found.withColumn("place", place).where(F.col("place") <= options.max_matches).mapInPandas(trace, TRACED)
