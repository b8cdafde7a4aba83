"""Packing pieces into sequences of a fixed length.

Both packers plan on the histogram of piece lengths, which has at most ``limit`` rows whatever the corpus holds:
pieces of one length are interchangeable. A plan is a list of runs ``(length, first, each, bins, bin, offset)``: of
the pieces of this length, in any fixed order, those from number ``first`` on go ``each`` to every one of ``bins``
sequences from number ``bin`` on, one after another from ``offset``. The executors number the pieces of each length
(salted, so that a length that a third of all pieces have is no single task) and look the runs up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read, saved
from .tokens import cut_pieces

Runs = list[tuple[int, int, int, int, int, int]]


def minimum_bin_slack(counts: dict[int, int], limit: int) -> Runs:
    """Fill bin after bin with the fullest combination of the lengths left, each bin around the longest of them.

    The sums that the lengths can reach are bits of one integer. Copies of a length join in powers of two (1, 2, 4,
    ... of them at once), so a length with many copies takes few shifts. The combination is read back from the
    bitsets, longest lengths first, and is repeated for as many bins as the counts allow.
    """
    left = {k: n for k, n in counts.items() if n > 0 and 0 < k <= limit}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: Runs = []
    bins = 0
    while left:
        longest = max(left)
        room = limit - longest
        chosen = {longest: 1}
        if room:
            for k, n in fullest({k: n - (k == longest) for k, n in left.items()}, room).items():
                chosen[k] = chosen.get(k, 0) + n
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for k in sorted(chosen, reverse=True):
            n = chosen[k]
            runs.append((k, used[k], n, times, bins, offset))
            offset += k * n
            used[k] += n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
        bins += times
    return runs


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum within room; a full room ends the search early."""
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((k for k, n in counts.items() if n > 0 and k <= room), reverse=True):
        many = min(counts[length], room // length)
        step = 1
        while many > 0:
            take = min(step, many)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            many -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class CapacityTree:
    """A segment tree over capacities 0..limit that finds the smallest capacity >= need that has bins."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at //= 2

    def smallest(self, need: int) -> int | None:
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], limit: int) -> Runs:
    """Longest first, each piece into the bin with the least room that takes it.

    Bins of equal room are alike. Best fit fills one of them with as many pieces of the length as it holds before it
    turns to the next, so a whole class of bins is filled at a time, and the runs stay as few as the lengths.
    """
    tree = CapacityTree(limit)
    classes: dict[int, list[tuple[int, int]]] = {}
    runs: Runs = []
    bins = 0

    def put(capacity: int, first: int, n: int) -> None:
        classes.setdefault(capacity, []).append((first, n))
        tree.add(capacity, n)

    for length in sorted((k for k, n in counts.items() if n > 0 and 0 < k <= limit), reverse=True):
        n, used = counts[length], 0
        while n > used:
            left = n - used
            capacity = tree.smallest(length)
            if capacity is None:
                capacity = limit
                each = limit // length
                whole, rest = divmod(left, each)
                parts = [(bins, whole, each)] * (whole > 0) + [(bins + whole, 1, rest)] * (rest > 0)
                bins += whole + (rest > 0)
            else:
                first, have = classes[capacity].pop()
                tree.add(capacity, -have)
                each = capacity // length
                whole = min(have, left // each)
                rest = left - whole * each if whole < have else 0
                rest = min(rest, each)
                parts = [(first, whole, each)] * (whole > 0) + [(first + whole, 1, rest)] * (rest > 0)
                spare = have - whole - (rest > 0)
                if spare:
                    put(capacity, first + whole + (rest > 0), spare)
            for first, have, each in parts:
                runs.append((length, used, each, have, first, limit - capacity))
                used += each * have
                put(capacity - each * length, first, have)
    return runs


def placed(pieces: DataFrame, runs: Runs) -> DataFrame:
    """pieces(length, rank, ...) with sequence_id and offset."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    bounds = {int(k): (int(a), int(b)) for k, a, b in _spans(table[:, 0])}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.zeros(len(batch), dtype=np.int64)
            rank = batch["rank"].to_numpy()
            length = batch["length"].to_numpy()
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                a, b = bounds[int(k)]
                at[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            _, first, each, _, bin_, offset = table[at].T
            yield batch.drop(columns="rank").assign(
                sequence_id=bin_ + (rank - first) // each, offset=offset + (rank - first) % each * length
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "rank")
    return pieces.mapInPandas(place, schema + ", sequence_id long, offset long")


def _spans(values: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(values):
        return []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return [(values[a], a, b) for a, b in zip(starts, [*starts[1:], len(values)], strict=True)]


def histogram(pieces: DataFrame) -> dict[int, int]:
    """Pieces by length: at most as many rows as a sequence has places."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(docs: DataFrame, limit: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Best-fit packing by minimum bin slack: one row per piece with its sequence and place.

    Null and empty texts are one piece with the end id. Rows of one doc_id, null included, are packed each by
    itself. An empty table gives no rows. Other columns are ignored.
    """
    pieces = saved(cut_pieces(docs, tokenizer, limit, end_id).withColumn("number", F.monotonically_increasing_id()), "pieces")
    rows = placed(ranked(pieces, "length", ["number"], few_groups=True), minimum_bin_slack(histogram(pieces), limit))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
