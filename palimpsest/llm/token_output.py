"""Packed token ids as binary matrices.

Pieces are packed by best-fit decreasing (``packing.best_fit_decreasing``), then brought together by sequence. A
sequence holds at most ``limit`` ids, so what is gathered for one row is bounded. Ids and positions are written as
little-endian unsigned 16-bit integers; the vocabulary and the length of a sequence stay below 65,536.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read, saved
from .packing import best_fit_decreasing, histogram, placed
from .tokens import cut_pieces

SCHEMA = (
    "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, "
    "position_resets array<int>, input_ids binary, position_ids binary"
)


def packed_ids(docs: DataFrame, limit: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """One row per sequence, its segments in order of their places.

    ``input_ids`` is a row of the id matrix: ``limit`` ids, padded with pad_id. ``cu_seqlens`` are the cumulative
    segment lengths from 0 on; ``position_resets`` the places at which positions start again from 0, and
    ``position_ids`` the positions themselves, 0 in the padding. Overlong documents are cut without loss: the pieces
    of a document, one after another, are its ids. Null and empty texts are the end id alone; rows of one doc_id, null
    included, are packed each by itself, their pieces not told apart but by their ids; an empty table gives no rows;
    other columns are ignored.
    """
    cut = cut_pieces(docs, tokenizer, limit, end_id, keep_ids=True)
    pieces = saved(cut.withColumn("number", F.monotonically_increasing_id()), "ids")
    runs = best_fit_decreasing(histogram(pieces), limit)
    # lengths alone are ranked; the ids move once to their places and once into their sequences
    places = placed(ranked(pieces.select("number", "length"), "length", ["number"], few_groups=True), runs)
    rows = pieces.join(places.select("number", "sequence_id", "offset"), "number")
    segment = F.struct("offset", "length", "doc_id", "piece", "ids")
    rows = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(segment)).alias("segments"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.arange(limit, dtype="<u2")
        padding = np.array([pad_id], "<u2").tobytes()
        for batch in batches:
            out = []
            for sequence_id, segments in zip(batch["sequence_id"], batch["segments"], strict=True):
                lengths = [s["length"] for s in segments]
                ends = np.cumsum([0, *lengths])
                n = int(ends[-1])
                positions = np.zeros(limit, "<u2")
                for at, length in zip(ends, lengths, strict=False):
                    positions[at : at + length] = count[:length]
                ids = b"".join([bytes(s["ids"]) for s in segments]) + padding * (limit - n)
                docs_ = [s["doc_id"] for s in segments]
                out.append((sequence_id, n, docs_, [s["piece"] for s in segments], ends.tolist(), ends[:-1].tolist(), ids, positions.tobytes()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInPandas(write, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed sequences as Parquet files, each row group a slice of the id matrix."""
    packed_ids(docs, **options).write.mode("overwrite").parquet(path, compression="zstd")


def packed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids(read(spark, sf_dir, "documents"))
