"""Documents to sentences, tokens and vocabulary."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from palimpsest.functions import text as T


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, sentence, tokens, n_tokens, max_len_s), made within the row of its document: no shuffle."""
    whole = docs.select("doc_id", T.sentence_array(F.col("text")).alias("all"))
    whole = whole.withColumn("words", F.transform("all", T.token_array))
    whole = whole.withColumn("max_len_s", F.coalesce(F.array_max(F.transform("words", lambda w: F.size(w))), F.lit(0)))
    rows = whole.select("doc_id", "max_len_s", F.posexplode(F.arrays_zip("all", "words")).alias("sentence_id", "s"))
    return rows.select(
        "doc_id", "sentence_id", F.col("s.all").alias("sentence"), F.col("s.words").alias("tokens"),
        F.size("s.words").alias("n_tokens"), "max_len_s",
    )


@F.pandas_udf(ArrayType(LongType()))
def before(sizes: pd.Series) -> pd.Series:
    """For each element of an array of sizes the sum of those before it."""
    return sizes.map(lambda x: np.cumsum(x, dtype=np.int64) - x)


def placed_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, text, found): for each document its tokens as array<struct<part, len, idx>>, made within its row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(T.PIECE), F.lit(0)).alias("part"))
    parts = parts.withColumn("len", F.transform("part", lambda p: F.octet_length(p)))
    rows = parts.withColumn("idx", before("len"))
    return rows.select("doc_id", "text", F.filter(F.arrays_zip("part", "len", "idx"), lambda x: x["part"].rlike(f"^{T.TOKEN}")).alias("found"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token_no, idx, len, token, pos, tag): UTF-8 byte offsets; no shuffle."""
    rows = placed_tokens(docs).select("doc_id", F.posexplode("found").alias("token_no", "t"))
    token = F.lower("t.part")
    return rows.select(
        "doc_id", "token_no", "t.idx", "t.len", token.alias("token"), T.universal_pos(token).alias("pos"), T.penn_tag(token).alias("tag")
    )


def sentence_table(found: DataFrame) -> DataFrame:
    """token_at: tokens before the sentence in its document."""
    before = W.partitionBy("doc_id").orderBy("sentence_id").rowsBetween(W.unboundedPreceding, -1)
    return found.select(
        "doc_id", "sentence_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_at")
    )


def sentence_texts(docs: DataFrame) -> DataFrame:
    """Text from a sentence's first token to the first token of the next one, made within the row: as byte slices where a text has
    characters that Java and Python may tell apart otherwise."""
    plain = T.is_plain(F.col("text"))
    cut = F.pandas_udf(lambda texts: texts.map(T.plain_sentence_texts), ArrayType(StringType()))
    whole = docs.where(plain).select("doc_id", F.posexplode(cut("text")).alias("sentence_id", "sentence_text"))
    return whole.unionByName(sliced_texts(docs.where(~plain)))


def sliced_texts(docs: DataFrame) -> DataFrame:
    counts = F.transform(T.sentence_array(F.col("text")), lambda s: F.size(F.regexp_extract_all(s, F.lit(T.TOKEN), F.lit(0))))
    rows = placed_tokens(docs).withColumn("counts", counts).withColumn("first", before("counts"))
    rows = rows.withColumn("starts", F.transform("first", lambda k: F.get("found", k.cast("int"))["idx"]))
    length = F.octet_length("text").cast("long")

    def cut(raw):
        return F.transform("starts", lambda at, i: F.substring(raw, at.cast("int") + 1, (F.coalesce(F.get("starts", i + 1), length) - at).cast("int")).cast("string"))

    texts = F.get(F.transform(F.array(F.encode("text", "utf-8")), cut), F.lit(0))
    return rows.select("doc_id", F.posexplode(texts).alias("sentence_id", "sentence_text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n)"""
    words = F.flatten(F.transform(T.sentence_array(F.col("text")), T.token_array))
    return docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(token, n, prob, idf): one partial and one final aggregation; the only thing sent to all rows is one total."""
    counts = word_counts(docs) if counts is None else counts
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "token", "n", F.ln(F.col("n") / F.col("total")).alias("prob"), (-F.ln(F.col("n") / F.col("total"))).alias("idf")
    )


def document_stats(docs: DataFrame) -> DataFrame:
    return sentences(docs).groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_sentences"), F.max("n_tokens").alias("max_len_s")
    )


def numbered(rows: DataFrame, coarse: list[str], order: list, most: DataFrame | None = None) -> DataFrame:
    """rows with ``r``, their place from 0 on, in the order of the coarse columns and of ``order`` among equal ones.

    Counts of the coarse columns tell where each group begins, and a window numbers the rows of a group, so no task sorts
    all. With most(n), groups that begin at n or later are left out.
    """
    counts = rows.groupBy(*coarse).agg(F.count(F.lit(1)).alias("_c"))
    before = W.orderBy(*coarse).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*coarse, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    if most is not None:
        starts = starts.crossJoin(F.broadcast(most)).where("_start < n").drop("n")  # one row
    inside = W.partitionBy(*coarse).orderBy(*order)
    return rows.join(starts, coarse).withColumn("r", F.col("_start") + F.row_number().over(inside) - 1).drop("_start")


def embedded_vocabulary(docs: DataFrame, vectors: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(token, n, idf, vec_id, raw): the r-th most frequent token has the vector with the r-th smallest id, from 0."""
    words = vocabulary(docs, counts).withColumns({"_less": -F.col("n"), "_head": F.substring("token", 1, 2)})
    words = numbered(words, ["_less", "_head"], ["token"], vectors.agg(F.count(F.lit(1)).alias("n")))
    own = vectors.withColumn("_block", F.shiftright("vec_id", 16))
    own = numbered(own, ["_block"], ["vec_id"])
    return words.join(own.select("r", "vec_id", "embedding"), "r").select("token", "n", "idf", "vec_id", F.col("embedding").alias("raw"))


def determiner_filter(found: DataFrame) -> DataFrame:
    return found.where("pos <> 'DET'")


def punctuation_filter(found: DataFrame, pos: Column | str = "pos") -> DataFrame:
    return found.where(F.col(pos) != "PUNCT" if isinstance(pos, str) else pos != "PUNCT")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, doc_signature, signature, sentence)."""
    title = F.concat_ws(" ", "lang", F.col("doc_id").cast("string"))
    own = docs.select("doc_id", T.document_signature(F.col("source"), title, F.coalesce("text", F.lit(""))).alias("doc_signature"))
    sentence = F.trim("sentence")
    return sentences(docs).join(own, "doc_id").select(
        "doc_id", "sentence_id", "doc_signature", T.sentence_signature(sentence, F.col("sentence_id")).alias("signature"), sentence.alias("sentence")
    )


def duplicate_signatures(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_signature").agg(F.countDistinct("doc_id").alias("n")).where("n > 1")


def resolve(wanted: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted(doc_signature, signature) to (doc_id, sentence_id), and those that nothing matches."""
    keys = ["doc_signature", "signature"]
    return wanted.join(found.select(*keys, "doc_id", "sentence_id"), keys), wanted.join(found, keys, "left_anti")


def resolve_quotes(quotes: DataFrame, found: DataFrame) -> DataFrame:
    """quotes(quote_id, quote) to the sentences that hold them.

    A quote can only stand in a sentence that has its longest word, so the join is on that word and the
    containment test runs on those rows alone.
    """
    q = quotes.select("quote_id", T.normalised(F.col("quote")).alias("quote")).where("quote <> ''")
    word = F.reduce(F.split("quote", " "), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    q = q.withColumn("word", word)
    s = found.select("doc_id", "sentence_id", T.normalised(F.col("sentence")).alias("sentence"))
    s = s.withColumn("word", F.explode(F.array_distinct(F.split("sentence", " "))))
    held = s.join(q, "word")
    return held.where(F.contains(F.concat(F.lit(" "), "sentence", F.lit(" ")), F.concat(F.lit(" "), "quote", F.lit(" ")))).select(
        "quote_id", "doc_id", "sentence_id"
    )
