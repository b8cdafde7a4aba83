"""Removing repeated byte strings by distributed prefix doubling on sampled suffixes.

A byte goes when a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id. Ranking
every suffix of the corpus would sort one row per byte in every round; here the suffixes are sampled, and names (64-bit
hashes) stand for ranks. In every window of ``length`` bytes the least 16-byte string by hash is its anchor, so equal
windows have equal anchors and consecutive windows share one (about one anchor per 18 bytes). An anchor stands for two
things apart, each with a name of its own: the windows that hold the 17 bytes before it, and the others, which hold the
18 bytes after it. (Names of 16 bytes alone would recur by chance ever more often as the corpus grows, and so would the
windows sent for them; those of 33 and 34 bytes seldom do.) The rounds sort names at growing lengths and drop what is
unique:

1. 33 or 34 bytes: the anchor's name. Anchors that one batch of documents alone has, and there one document alone, drop
   out.
2. up to 67 bytes: the pair (name of the anchor, name of all windows that share it). Where the least document of the
   pair is smaller than an occurrence's own, all its windows are repeats. An anchor with one such pair is finished.
3. ``length`` bytes: the single windows of anchors with several pairs, from the least document of each pair.

Names travel in arrays, one row per (batch, bucket), made distinct within the batch, so a passage that a third of all
documents have is one entry per batch. The documents lie in a table bucketed by batch: the rounds read it without
moving the texts again. Exact copies of a text are settled by their digest beforehand.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_end, free, read, saved, shuffles_freed

GRAM = 16
BATCH_BYTES = 2 << 20
BATCHES_PER_BUCKET = 4
NAMES_PER_GROUP = 2_000_000
NULL_ID = np.iinfo(np.int64).max
PLACE_BITS = np.uint64(31)
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
C_INVERSE = np.uint64(pow(int(C), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= B
    x ^= x >> np.uint64(27)
    x *= C
    x ^= x >> np.uint64(31)
    return x


class Anchors:
    """The anchors of a batch of texts: for each its name, its document, and its windows first..last.

    An anchor whose windows lie on both sides (enough bytes before it, or not) is two.
    """

    def __init__(self, texts: list[bytes], ids: np.ndarray, length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        raw = b"".join(texts)
        n = len(raw)
        windows = np.concatenate([np.arange(s, s + size - length + 1) for s, size in zip(self.start, sizes, strict=False) if size >= length] or [np.zeros(0, np.int64)])
        self.words = np.zeros(0, np.uint64)
        if not len(windows):
            self.name = self.text_name = np.zeros(0, np.uint64)
            self.doc = self.first = self.last = np.zeros(0, np.int64)
            return
        words = np.ndarray(n - 7, "<u8", raw, 0, (1,)).copy()
        grams = mixed(words[: n - 15] * A + mixed(words[8:]))
        keys = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        have, want = 1, length - GRAM + 1
        while have < want:
            step = min(have, want - have)
            keys = np.minimum(keys[: len(keys) - step], keys[step:])
            have += step
        at = (keys[windows] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        half = (length - GRAM) // 2
        left = at - windows >= half
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1) | (left[1:] != left[:-1])])
        self.first = windows[new]
        self.last = windows[np.r_[new[1:], len(windows)] - 1]
        anchor, left = at[new], left[new]
        self.doc = ids[np.searchsorted(self.start, self.first, side="right") - 1]
        # sums of words times powers name any span
        power = np.cumprod(np.full(n - 7, C))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * power)])
        self.back = np.cumprod(np.full(n - 7, C_INVERSE))
        self.name = self.span(np.where(left, anchor - half, anchor), np.where(left, anchor + GRAM, anchor + length - half + 1))
        where = (anchor - self.first).astype(np.uint64) << np.uint64(32) | (self.last - self.first).astype(np.uint64)
        self.text_name = mixed(self.span(self.first, self.last + length) + where * A)

    def span(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end - 7] - self.sums[first]) * self.back[first])

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of these anchors: number of the anchor in ``which``, start."""
        counts = self.last[which] - self.first[which] + 1
        owner = np.repeat(np.arange(len(which)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return owner, self.first[which][owner] + inside


def least(keys: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, the least document of each, and for every input row the number of its key."""
    order = np.lexsort([doc, *reversed(keys)])
    ordered = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in ordered:
        new[1:] |= k[1:] != k[:-1]
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return [k[new] for k in ordered], doc[order][new], number


class Batch:
    """What the rounds share for one batch; each round adds the answers of the one before."""

    def __init__(self, rows: pd.DataFrame, answers: pd.DataFrame, buckets: int, length: int):
        self.rows, self.buckets = rows, buckets
        self.ids = rows["_id"].to_numpy()
        self.texts = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
        told = answers[answers["round"] == 0]
        copies = {(int(i), bytes(d)) for i, d in zip(told["id"], told["blob"], strict=True)}
        self.copy = np.array([(int(i), bytes(d)) in copies for i, d in zip(self.ids, rows["digest"], strict=True)], bool)
        own = [b"" if c else t for c, t in zip(self.copy, self.texts, strict=True)]
        self.anchors = Anchors(own, self.ids, length)

    def deal(self, names: np.ndarray) -> np.ndarray:
        return (names % np.uint64(self.buckets)).astype(np.int64)

    def gathered(self, answers: pd.DataFrame, names: np.ndarray, round_: int, kind: str, fill) -> np.ndarray:
        """Answers of a round in the order of the distinct names."""
        out = np.full(len(names), fill, kind)
        dealt = self.deal(names)
        answers = answers[answers["round"] == round_]
        for bucket, blob in zip(answers["bucket"], answers["blob"], strict=True):
            own = np.flatnonzero(dealt == bucket)
            out[own] = flags_of(blob, len(own)) if kind is bool else np.frombuffer(blob, kind)[: len(own)]
        return out

    def first(self) -> tuple[list[np.ndarray], np.ndarray]:
        a = self.anchors
        (names,), lowest, number = least([a.name], a.doc)
        highest = np.full(len(names), -1 << 63, np.int64)
        np.maximum.at(highest, number, a.doc)
        self.several = (lowest < highest)[number]
        self.number = number
        return names

    def second(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = self.first()
        elsewhere = self.gathered(answers, names, 1, bool, False)[self.number]
        self.left = np.flatnonzero(self.several | elsewhere)
        a = self.anchors
        (names, texts), doc, self.pair = least([a.name[self.left], a.text_name[self.left]], a.doc[self.left])
        return names, texts, doc

    def third(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        names, _, _ = self.second(answers)
        found = self.gathered(answers, names, 2, "<i8", 0)  # the least document, negative less one where several pairs are
        several = found < 0
        lowest = np.where(several, -1 - found, found)[self.pair]
        doc = self.anchors.doc[self.left]
        self.whole = self.left[lowest < doc]
        self.single = self.left[several[self.pair] & (lowest == doc)]
        owner, start = self.anchors.windows(self.single)
        self.starts = start
        window = self.anchors.span(start, start + self.anchors.length) if len(start) else np.zeros(0, np.uint64)
        (windows,), doc, self.window = least([window], self.anchors.doc[self.single][owner])
        return windows, doc

    def removed(self, answers: pd.DataFrame) -> np.ndarray:
        """A flag for each byte of the batch."""
        windows, doc = self.third(answers)
        a = self.anchors
        repeated = np.zeros(len(windows), bool)
        told = answers[answers["round"] == 3]
        flags = dict(zip(told["bucket"], told["blob"], strict=True))
        for bucket, own in by_document(self.deal(windows), doc):
            repeated[own] = flags_of(flags[bucket], len(own))
        # within the batch, the names' least document may not be the occurrence's own
        owner, start = a.windows(self.single)
        hit = start[repeated[self.window] | (doc[self.window] < a.doc[self.single][owner])]
        size = int(a.start[-1])
        edges = np.bincount(a.first[self.whole], minlength=size + 1).astype(np.int64) + np.bincount(hit, minlength=size + 1)
        edges -= np.bincount(a.last[self.whole] + a.length, minlength=size + 1) + np.bincount(hit + a.length, minlength=size + 1)
        return np.cumsum(edges)[:size] > 0


def _by_bucket(batch: int, dealt: np.ndarray, record: np.ndarray) -> pd.DataFrame:
    order = np.argsort(dealt, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(dealt[order]) != 0]) if len(order) else []
    out = [(int(dealt[own[0]]), batch, record[own].tobytes()) for own in np.split(order, bounds[1:])] if len(order) else []
    return pd.DataFrame(out, columns=["bucket", "batch", "blob"])


def _joined(rows: pd.DataFrame, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, kind) for x in rows["blob"]]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1]


def by_document(dealt: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each bucket its entries in order of their documents."""
    order = np.lexsort([doc, dealt])
    cuts = np.flatnonzero(np.diff(dealt[order])) + 1
    return [(int(dealt[own[0]]), own) for own in np.split(order, cuts)] if len(order) else []


def narrow(values: np.ndarray) -> np.ndarray:
    """In as few bytes each as the greatest needs."""
    return values.astype(np.min_scalar_type(values.max(initial=0)))


def runs_blob(names: np.ndarray, doc: np.ndarray) -> bytes:
    """Names of documents in order: how many documents, the first id, the steps to the others, how many names each has, the names.

    A bucket of a batch has ever fewer names the more buckets there are, so ids and counts are kept narrow.
    """
    ids, counts = np.unique(doc, return_counts=True)
    steps, counts = narrow(np.diff(ids).view(np.uint64)), narrow(counts)
    head = np.array([len(ids), ids[0], steps.itemsize, counts.itemsize], "<i8")
    return b"".join(x.tobytes() for x in (head, steps, counts, names))


def read_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, step, count = (int(x) for x in np.frombuffer(blob, "<i8", 4))
    steps = np.frombuffer(blob, f"<u{step}", n - 1, 32)
    counts = np.frombuffer(blob, f"<u{count}", n, 32 + (n - 1) * step)
    names = np.frombuffer(blob, "<u8", -1, 32 + (n - 1) * step + n * count)
    ids = np.cumsum(np.concatenate([np.array([first], np.int64).view(np.uint64), steps.astype(np.uint64)])).view(np.int64)
    return names, np.repeat(ids, counts)


def flags_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


ANSWER = "batch long, round int, bucket long, id long, blob binary"


def _answer(rows: pd.DataFrame, round_: int, values: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
    blobs = [(np.packbits(x) if x.dtype == bool else x).tobytes() for x in np.split(values, cuts)]
    return pd.DataFrame({"batch": rows["batch"], "round": round_, "bucket": rows["bucket"], "id": 0, "blob": blobs})


def find_repeats(docs: DataFrame, length: int = 50, columns: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """(doc_id, *columns, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) for each row.

    A null text is empty. Texts shorter than ``length`` lose nothing. Rows of one doc_id are documents of their own
    that do not count against each other; a null doc_id counts as the greatest long. A span is a maximal run of
    removed bytes. kept_text is what is left, read as UTF-8; parts of characters cut apart are left out of it. A text
    is held whole in one task, with about 60 bytes of arrays for each byte. An empty table gives no rows.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    with shuffles_freed(spark):
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    n_files = max(1, -(-batches // BATCHES_PER_BUCKET))
    per_text = (length - GRAM + 2) / 2 / 1.4  # some two anchors in five are two
    buckets = max(1, int(total / per_text / NAMES_PER_GROUP))
    digest = F.unhex(F.sha2(text, 256))
    own = [F.col(c).alias(f"own_{k}") for k, c in enumerate(columns)]
    null_id = F.col("doc_id").isNull().alias("_null_id")
    rows = docs.select(F.coalesce("doc_id", F.lit(int(NULL_ID))).cast("long").alias("_id"), null_id, text.alias("text"), *own, digest.alias("digest"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("_id", "digest"), F.lit(batches)))
    name = f"suffix_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        rows.repartition(n_files, "batch").write.bucketBy(n_files, "batch").option("compression", "zstd").saveAsTable(name, format="parquet")
    at_end(_drop, spark, name)
    table = spark.table(name)

    ids = table.select("batch", F.col("_id").alias("id"), "digest")
    firsts = ids.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = ids.join(firsts, "digest").where("id > least").select("batch", F.lit(0).alias("round"), F.lit(0).cast("long").alias("bucket"), "id", F.col("digest").alias("blob"))
    answers = saved(copies.distinct(), "copies")

    def ask(step, schema="bucket long, batch long, blob binary"):
        own = table.select("batch", "_id", "text", "digest").groupBy("batch")
        return own.cogroup(answers.groupBy("batch")).applyInPandas(step, schema)

    def first(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _by_bucket(0, np.zeros(0, np.int64), np.zeros(0))
        batch = Batch(rows, answers, buckets, length)
        names = batch.first()
        return _by_bucket(int(rows["batch"].iloc[0]), batch.deal(names), (names >> np.uint64(32)).astype("<u4"))

    def meet_first(rows: pd.DataFrame) -> pd.DataFrame:
        names, cuts = _joined(rows, "<u4")
        _, number, counts = np.unique(names, return_inverse=True, return_counts=True)
        return _answer(rows, 1, counts[number] > 1, cuts)

    def told(answers: DataFrame, more: DataFrame) -> DataFrame:
        both = saved(answers.union(more), "answers")
        free(answers)
        return both

    answers = told(answers, ask(first).groupBy("bucket").applyInPandas(meet_first, ANSWER))

    def second(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _by_bucket(0, np.zeros(0, np.int64), np.zeros(0))
        batch = Batch(rows, answers, buckets, length)
        names, texts, doc = batch.second(answers)
        record = np.stack([names, texts, doc.view(np.uint64)], axis=1)
        return _by_bucket(int(rows["batch"].iloc[0]), batch.deal(names), record)

    def meet_second(rows: pd.DataFrame) -> pd.DataFrame:
        record, cuts = _joined(rows, "<u8")
        names, texts, doc = record.reshape(-1, 3).T
        (distinct, _), lowest, number = least([names, texts], doc.view(np.int64))
        several = np.zeros(len(distinct), bool)
        same = distinct[1:] == distinct[:-1]
        several[1:] |= same
        several[:-1] |= same
        values = np.where(several, -1 - lowest, lowest)[number].astype("<i8")
        return _answer(rows, 2, values, cuts // 3)

    answers = told(answers, ask(second).groupBy("bucket").applyInPandas(meet_second, ANSWER))

    def third(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _by_bucket(0, np.zeros(0, np.int64), np.zeros(0))
        batch = Batch(rows, answers, buckets, length)
        windows, doc = batch.third(answers)
        number = int(rows["batch"].iloc[0])
        out = [(bucket, number, runs_blob(windows[own], doc[own])) for bucket, own in by_document(batch.deal(windows), doc)]
        return pd.DataFrame(out, columns=["bucket", "batch", "blob"])

    def meet_third(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [read_runs(x) for x in rows["blob"]]
        windows, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, lowest, number = least([windows], doc)
        return _answer(rows, 3, lowest[number] < doc, np.cumsum([len(x) for x, _ in parts])[:-1])

    answers = told(answers, ask(third).groupBy("bucket").applyInPandas(meet_third, ANSWER))
    out_columns = ["doc_id", *columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text]

    def last(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=out_columns)
        batch = Batch(rows, answers, buckets, length)
        flags = batch.removed(answers)
        out = []
        for k, text in enumerate(batch.texts):
            kept, n, spans = text, 0, 0
            if batch.copy[k]:
                if len(text) >= length:
                    kept, n, spans = b"", len(text), 1
            else:
                own = flags[batch.anchors.start[k] : batch.anchors.start[k + 1]]
                if own.any():
                    n = int(own.sum())
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~own].tobytes()
            out.append((len(text), n, spans, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * keep_text))
        made = pd.DataFrame(out, columns=out_columns[1 + len(columns) :])
        for k, c in enumerate(columns):
            made[c] = rows[f"own_{k}"].to_numpy()
        made["doc_id"] = pd.arrays.IntegerArray(batch.ids.copy(), rows["_null_id"].to_numpy(bool))
        return made[out_columns]

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(
        ["doc_id long", *[f"`{c}` {kinds[c]}" for c in columns], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["kept_text string"] * keep_text]
    )
    own = table.groupBy("batch")
    return own.cogroup(answers.groupBy("batch")).applyInPandas(last, schema)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended
        pass


def find_repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(read(spark, sf_dir, "documents"))
