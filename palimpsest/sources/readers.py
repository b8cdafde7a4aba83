"""Reading corpora and word vectors."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKENS = "doc_id long, idx long, len int, pos string, tag string, prob double"
SENTENCES = "doc_id long, book int, chapter int, speaker int, location int, n_tokens int"


def corpus_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored tokens and sentences, read under fixed schemas."""
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens.parquet"), spark.read.schema(SENTENCES).parquet(f"{path}/sentences.parquet")


def embedding_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, embedding) from columns token, v0, v1, ..."""
    rows = spark.read.parquet(path)
    columns = sorted((c for c in rows.columns if re.fullmatch(r"v\d+", c)), key=lambda c: int(c[1:]))
    return rows.select("token", F.array(*columns).alias("embedding"))


def word_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines "token f f f"; the header and tokens that are not lower-case letters alone go."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    token = F.col("p")[0]
    rows = rows.where(token.rlike(r"^\p{L}+$") & (F.lower(token) == token))
    return rows.select(token.alias("token"), F.slice("p", 2, 1 << 20).cast("array<float>").alias("embedding"))


def numpy_matrix(spark: SparkSession, matrix_path: str, words_path: str) -> DataFrame:
    """(token, embedding) from two .npy files, read through Spark so that any store will do, in one executor's task.

    A file is one record, so it can have 2 GB at most; the rows are then dealt out by token.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = {}
        for batch in batches:
            for is_words, content in zip(batch["is_words"], batch["content"], strict=True):
                arrays[bool(is_words)] = np.load(io.BytesIO(content), allow_pickle=False)
        if arrays:
            words, matrix = arrays[True].astype(str), arrays[False].astype("float32")
            for at in range(0, len(words), 10_000):
                yield pd.DataFrame({"token": words[at : at + 10_000], "embedding": list(matrix[at : at + 10_000])})

    files = lambda path, words: spark.read.format("binaryFile").load(path).select(F.lit(words).alias("is_words"), "content")
    both = files(matrix_path, False).union(files(words_path, True)).coalesce(1)
    return both.mapInPandas(parse, "token string, embedding array<float>").repartition("token")


# How chapters are announced.
CHAPTER = r"(?iU)\n\n\n\W*chapter\s+(\d+)[^\n]*\n\n"
PARTS = ["path", "book", "chapter", "speaker", "location", "text", "name"]
BREAK = "\n\n"


def chapters(text: Column) -> Column:
    """array<struct<book, chapter, text>> of a novel. What no chapter holds is (-1, -1).

    Numbers must be 1 or follow the one before; else the text has no chapters. Every 1 begins a book. Books of one chapter before
    the first longer one are a table of contents and belong to what stands before the chapters, unless all are as
    short: then the last is the text. A single book has no number.
    """
    marks, bodies = F.regexp_extract_all(text, F.lit(CHAPTER), F.lit(0)), F.split(text, CHAPTER, -1)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CHAPTER), F.lit(1)), lambda n: n.try_cast("int"))
    places = F.transform(numbers, lambda n, i: i)
    firsts = F.filter(places, lambda i: F.get(numbers, i) == 1)
    after = F.transform(numbers, lambda n, i: F.coalesce(n == 1, F.lit(False)) | F.coalesce(n == F.get(numbers, i - 1) + 1, F.lit(False)))
    good = (F.size(numbers) > 0) & F.coalesce(F.get(numbers, F.lit(0)) == 1, F.lit(False)) & F.forall(after, lambda x: x)
    longer = F.filter(firsts, lambda i: F.coalesce(F.get(numbers, i + 1) == 2, F.lit(False)))
    begin = F.coalesce(F.get(longer, F.lit(0)), F.get(firsts, F.size(firsts) - 1))
    books = F.filter(firsts, lambda i: i >= begin)

    def piece(book: Column, chapter: Column, own: Column) -> Column:
        return F.struct(book.cast("int").alias("book"), chapter.cast("int").alias("chapter"), own.alias("text"))

    none = F.lit(-1)
    book = lambda i: F.when(F.size(books) > 1, F.size(F.filter(books, lambda j: j <= i))).otherwise(none)
    found = F.transform(F.filter(places, lambda i: i >= begin), lambda i: piece(book(i), F.get(numbers, i), F.concat(F.get(marks, i), F.get(bodies, i + 1))))
    front = F.array_join(F.transform(F.filter(places, lambda i: i < begin), lambda i: F.concat(F.get(bodies, i), F.get(marks, i))), "")
    front = F.concat(front, F.get(bodies, begin))
    front = F.filter(F.array(piece(none, none, front)), lambda x: x["text"] != "")
    return F.when(good, F.concat(front, found)).otherwise(F.array(piece(none, none, text)))


def paragraphs(part: Column) -> Column:
    """Paragraphs with the blank line that ends them; the last ends with the text."""
    own = F.split(part, BREAK, -1)
    return F.transform(own, lambda p, i: F.when(i < F.size(own) - 1, F.concat(p, F.lit(BREAK))).otherwise(p))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row for each .txt file below the path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def novel_parts(files: DataFrame) -> DataFrame:
    """Paragraphs of plain-text novels, made within the row of the file."""
    rows = files.select("path", F.explode(chapters(F.col("value"))).alias("c"))
    rows = rows.select("path", "c.book", "c.chapter", F.posexplode(paragraphs(F.col("c.text"))).alias("location", "text"))
    return rows.withColumns({"speaker": F.lit(-1), "name": F.lit(None).cast("string")}).select(PARTS)


def novels(spark: SparkSession, path: str) -> DataFrame:
    return novel_parts(text_files(spark, path))


def _speaker_ids(rows: DataFrame, keys: list[str], name: str, at: str) -> DataFrame:
    """1-based ids in order of first appearance."""
    first = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.min(at).alias("_at"))
    return first.select(*keys, name, F.row_number().over(W.partitionBy(*keys).orderBy("_at")).alias("speaker"))


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").schema(schema).load(path)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def plays(spark: SparkSession, path: str) -> DataFrame:
    """Speeches of plays in XML: act, scene, speaker and the first line's number; lines joined by blanks.

    ``name`` is the speaker's full name, where the list of persons has one for the short form.
    """
    scenes = _xml(spark, path, "scene", "_actnum int, _num int, speech array<struct<speaker:string, line:array<struct<_VALUE:string, _globalnumber:int>>>>")
    rows = scenes.select("path", F.col("_actnum").alias("book"), F.col("_num").alias("chapter"), F.explode("speech").alias("s"))
    lines = F.filter("s.line", lambda x: F.trim(x["_VALUE"]) != "")
    rows = rows.select("path", "book", "chapter", F.col("s.speaker").alias("short"), lines.alias("lines")).where(F.size("lines") > 0)
    text = F.array_join(F.transform("lines", lambda x: F.trim(x["_VALUE"])), " ").alias("text")
    rows = rows.select("path", "book", "chapter", "short", F.col("lines")[0]["_globalnumber"].alias("location"), text)
    ids = _speaker_ids(rows, ["path"], "short", "location")
    persons = _xml(spark, path, "persname", "_short string, _VALUE string").where("_short IS NOT NULL")
    persons = persons.groupBy("path", F.col("_short").alias("short")).agg(F.min("_VALUE").alias("full"))
    rows = rows.join(ids, ["path", "short"], "left").join(persons, ["path", "short"], "left")
    return rows.select("path", "book", "chapter", F.coalesce("speaker", F.lit(-1)).alias("speaker"), "location", "text", F.coalesce("full", "short").alias("name"))


# Fixed value: a speaker before a colon, perhaps with a direction between.
SPEECH = r"^([\p{L}\p{N}_ ]+)[^:]*:(.*)$"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
STAGE = "stage instruction"


def script_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines(*keys, line_no, line) with name and text: a speaker before a colon, else a stage instruction.

    Lines are stripped first. Of those without a speaker, the ones in brackets and the airing date are left out; empty
    ones are stage instructions.
    """
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = lines.select(*keys, "line_no", line.alias("line")).withColumn("said", F.col("line").rlike(SPEECH))
    rows = rows.where(F.col("said") | ~(F.col("line").startswith("[") | F.col("line").startswith("Original Airdate:")))
    name = F.when(F.col("said"), F.upper(F.trim(F.regexp_extract("line", SPEECH, 1)))).otherwise(STAGE)
    text = F.when(F.col("said"), F.trim(F.regexp_extract("line", SPEECH, 2))).otherwise(F.col("line"))
    rows = rows.select(*keys, "line_no", name.alias("name"), text.alias("text"))
    return rows.join(_speaker_ids(rows, keys, "name", "line_no"), [*keys, "name"])


def screenplay_parts(files: DataFrame) -> DataFrame:
    own = F.split(F.regexp_replace("value", rf"({LINE_END})\z", ""), LINE_END, -1)
    rows = script_lines(files.select("path", F.posexplode(own).alias("line_no", "line")), ["path"])
    minus = F.lit(-1)
    return rows.select("path", minus.alias("book"), minus.alias("chapter"), "speaker", F.col("line_no").alias("location"), "text", "name")


def screenplays(spark: SparkSession, path: str) -> DataFrame:
    return screenplay_parts(text_files(spark, path))


def stable_id(path: Column) -> Column:
    """An id that depends on the path alone, not on what else is read or in which order."""
    return F.xxhash64(path).bitwiseAND((1 << 63) - 1)


def corpus_parts(spark: SparkSession, root: str) -> DataFrame:
    """Everything below ``novels/<author>``, ``screenplays/<series>`` and ``shakespeare``: (doc_id, category, *parts).

    Text files count in the first two folders, XML files in the third; any other file, such as a README, is skipped.
    """
    files = text_files(spark, root)
    inside = lambda rows, folder: rows.where(F.contains("path", F.lit(f"/{folder}/"))).withColumn("category", F.lit(folder))
    scripts = screenplay_parts(files.where(F.contains("path", F.lit("/screenplays/"))))
    out = inside(novel_parts(files.where(F.contains("path", F.lit("/novels/")))), "novels")
    out = out.unionByName(inside(scripts, "screenplays")).unionByName(inside(plays(spark, root), "shakespeare"))
    return out.select(stable_id(F.col("path")).alias("doc_id"), "category", *PARTS)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, category, author, title, path, speakers, text): one row for each document, ids stable.

    speakers maps a speaker's number to its name. A screenplay in a folder of its own has that folder in its title.
    """
    parts = corpus_parts(spark, root)
    order = ["book", "chapter", "location", "text"]
    texts = parts.groupBy("doc_id", "category", "path").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("all"))
    glue = F.when(F.col("category") == "novels", F.array_join("all.text", "")).otherwise(F.array_join("all.text", "\n"))
    names = parts.where("speaker > 0").select("doc_id", "speaker", "name").distinct()
    names = names.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("speaker", "name")))).alias("speakers"))
    below = F.split(F.element_at(F.split("path", F.concat(F.lit("/"), "category", F.lit("/"))), -1), "/")
    decoded = F.transform(below, lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
    stem = F.regexp_replace(F.element_at(decoded, -1), r"\.(txt|xml)$", "")
    titles = _xml(spark, root, "title", "_VALUE string").groupBy("path").agg(F.first("_VALUE").alias("own"))
    # Fixed value: whose plays the collection of plays has.
    author = F.when(F.col("category") == "shakespeare", "William Shakespeare").otherwise(decoded[0])
    episode = (F.col("category") == "screenplays") & (F.size(decoded) > 2)
    title = F.when(F.col("category") == "shakespeare", F.coalesce("own", stem)).when(episode, F.concat_ws(", ", F.element_at(decoded, -2), stem)).otherwise(stem)
    rows = texts.join(titles, "path", "left").join(names, "doc_id", "left")
    return rows.select("doc_id", "category", author.alias("author"), title.alias("title"), "path", "speakers", glue.alias("text"))


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages are no well-formed XML: scripts, styles and tags are cut out and blanks run together."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return pages.select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))
