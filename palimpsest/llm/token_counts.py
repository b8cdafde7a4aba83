"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

The vocabulary is read once: every piece's rank, and the pairs of neighbouring characters that occur inside any
piece. Where two characters are no such pair, no merge can ever cross, so a text falls into parts that merge by
themselves; blanks (written as U+2581) always begin a part. The counts of parts met before are kept in a bounded
dictionary, emptied when full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BLANK = "▁"
CACHE_PARTS = 1_000_000
LONGEST_CACHED = 48
SPACED = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class MergeCounter:
    """count(text): how many pieces the merges leave."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.prefix = BLANK if proto.normalizer_spec.add_dummy_prefix else ""
        normal = [p for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
        self.rank = {p.piece: -p.score for p in normal}
        self.inside = {p.piece[i : i + 2] for p in normal for i in range(len(p.piece) - 1)}
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def merged(self, part: str) -> int:
        """Symbols less merges. A character outside the vocabulary counts as its bytes, and stays so if unmerged."""
        rank = self.rank
        symbols = list(part)
        n = len(symbols)
        weight = [1 if c in rank else len(c.encode()) for c in symbols]
        count = sum(weight)
        if n == 1:
            return count
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            if (r := rank.get(symbols[i] + symbols[i + 1])) is not None:
                heap.append((r, i, symbols[i] + symbols[i + 1]))
        heapify(heap)
        while heap:
            _, i, piece = heappop(heap)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != piece:
                continue
            count -= weight[i] + weight[j] - 1
            weight[i] = 1
            symbols[i] = piece
            symbols[j] = ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(piece + symbols[k])) is not None:
                    heappush(heap, (r, i, piece + symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + piece)) is not None:
                heappush(heap, (r, h, symbols[h] + piece))
        return count

    def of_word(self, word: str) -> int:
        """word begins with its blanks."""
        inside, parts, start, count = self.inside, self.parts, 0, 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in inside:
                part = word[start:i]
                start = i
                if (n := parts.get(part)) is None:
                    n = self.merged(part)
                    if len(part) <= LONGEST_CACHED:
                        parts[part] = n
                count += n
        return count

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > CACHE_PARTS:
            self.words = {}
        if len(self.parts) > CACHE_PARTS // 2:
            self.parts = {}
        for word in words:
            self.words[word] = self.of_word(BLANK + word)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " " or not self.prefix:
            return sum(map(self.of_word, SPACED.findall(self.prefix + text.replace(" ", BLANK))))
        words = text.split(" ")
        get = self.words.get
        try:
            return sum(map(get, words))
        except TypeError:
            pass
        found = self.words
        long = [w for w in words if len(w) > LONGEST_CACHED]
        if long:
            words = [w for w in words if len(w) <= LONGEST_CACHED]
        new = {w for w in words if w not in found}
        total = sum(self.of_word(BLANK + w) for w in long)
        if len(new) > CACHE_PARTS // 4:
            return total + sum(self.of_word(BLANK + w) for w in words)
        self.learn(new)
        get = self.words.get
        return total + sum(n if (n := get(w)) is not None else self.of_word(BLANK + w) for w in words)


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; a null text has no bytes and no tokens.

    Every row is counted by itself, so repeated rows give repeated results; an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(public_tokenizers.path(model), "rb") as f:
            counter = MergeCounter(f.read())
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_bytes": batch["n_bytes"],
                "n_tokens": [counter.count(x) for x in batch["text"]],
            })

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
