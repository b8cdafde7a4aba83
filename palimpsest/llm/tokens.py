"""Token ids with a word cache, and the cutting of documents into pieces.

The word vocabulary drops white space and no pre-token crosses it, so the ids of a text are those of its
blank-separated chunks one after another. Each worker keeps the ids of the chunks it has met (a dictionary, emptied when
the next text's would make it too large) and asks the library only for new ones. Chunks are cut at space and line feed alone; any other
white space stays inside its chunk, where the library treats it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 1_000_000
LONGEST_CACHED = 48
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
#: Marks that no pre-token shares with a letter before them: ASCII ones but the apostrophe, and "<" that may begin a special string.
MARKS = ".,!?;:$%&*#()-/\"@+=|~^"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one of those from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """ids(text) as little-endian unsigned 16-bit ids; the vocabulary has fewer than 65,536."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}

    def encoded(self, chunk: str) -> bytes:
        return array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Letters and the marks after them are separate pre-tokens, so a word is looked up without its marks."""
        cache, tokenize = self.cache, self.tokenizer.model.tokenize
        for chunk in chunks:
            low = chunk.lower()
            word = low.rstrip(MARKS)
            if len(low) != len(chunk) or not (word.isalpha() and (word.isascii() or PLAIN.fullmatch(word))):
                cache[chunk] = self.encoded(chunk)
                continue
            if (ids := cache.get(word)) is None:
                # a word of letters is one pre-token, already composed and in lower case: the model can take it as it is
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = array("H", [t.id for t in tokenize(spelled)]).tobytes()
                if len(word) <= LONGEST_CACHED:
                    cache[word] = ids
            if len(word) < len(low):
                marks = low[len(word) :]
                if (tail := cache.get(marks)) is None:
                    tail = cache[marks] = self.encoded(marks)
                ids += tail
            cache[chunk] = ids

    def ids(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        distinct = set(chunks)
        new = distinct.difference(self.cache)
        if not new:
            return b"".join(map(self.cache.__getitem__, chunks))
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {"": b""}
            new = distinct.difference(self.cache)
        long = [x for x in new if len(x) > LONGEST_CACHED]
        self.learn(new)
        found = b"".join(map(self.cache.__getitem__, chunks))
        for x in long:  # those are not met again
            del self.cache[x]
        return found


def cut_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with keep_ids the ids as 16-bit binary.

    A null text has the end id alone; every document so has one piece at least, and only the last is shorter than
    the limit. Rows of one doc_id are cut each by itself.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(public_tokenizers.path(tokenizer))
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = words.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 2 * limit)):
                    own = ids[at : at + 2 * limit]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at // 2)
                    out["length"].append(len(own) // 2)
                    out["ids_crc32"].append(zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes()))
                    if keep_ids:
                        out["ids"].append(own)
            if not keep_ids:
                del out["ids"]
            made = pd.DataFrame(out)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    schema = PIECES + (", ids binary" if keep_ids else "")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, schema)
