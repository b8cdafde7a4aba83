"""From raw documents to packed sequences, one operator after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` stores each stage's result and reads it again, so no stage is computed twice. What a stage has read and stored
beside its result goes as soon as that is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import minhash, mixing, packing, quality, suffix_dedup
from palimpsest.llm.common import read, saved, stored_meanwhile

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty ones; rows of repeated or null ids each by itself. An empty table stays
    empty. Here and in all stages, columns beside those of documents are left behind, whatever their names.
    """
    docs = docs.select(COLUMNS)
    weights = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, weights).where("predicted = 1").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id, null ids last.

    Every row is a document of its own: rows that share an id but not a group all stay. Only rows alike in id and text
    become one. Null, empty and blank texts have no words, are in no group and stay. An empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    leading = minhash.near_groups(docs).where("leads").withColumn("o", minhash.row_key()["o"]).select(minhash.ROW)
    rows = docs.withColumns(minhash.row_key()).join(leading, minhash.ROW, "left_semi")
    return rows.dropDuplicates([*minhash.ROW, "text"]).select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a document with a smaller doc_id has go; the rest of the text stays, n_chars follows it.

    Null texts become empty; documents that lose everything stay, empty. Rows of one id do not count against each
    other, null ids are greater than any other. An empty table stays empty.
    """
    left = suffix_dedup.find_repeats(docs.select(COLUMNS), columns=("lang", "source"), keep_text=True)
    left = left.withColumnRenamed("kept_text", "text")
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's target asks for, none to more than twice.

    A null source is a source of its own; texts without words have no size and are taken by their hash alone; rows of
    one id, null included, share their hash and are taken together. An empty table stays empty.
    """
    return mixing.mixed_documents(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the place that best-fit packing gives them.

    Null and empty texts are one piece with the end id; every row, repeats included, is packed. An empty table gives
    no rows.
    """
    return packing.pack(docs.select(COLUMNS))


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing, hashing and learned scores are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with stored_meanwhile() as made:
            docs = saved(stage(spark, docs, sf_dir), "stage")
        *own, result = made
        for forget in [*spent, *own]:
            forget()
        spent = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
