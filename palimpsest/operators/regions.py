"""What a match looks like in its text. Only the rows that a search returns come here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.align import gap_costs
from palimpsest.operators.corpus import sentence_table

CONTEXT = 10
REGION = "s string, mismatch_penalty double, t string, similarity double, weight double, pos_s string, pos_t string, metric string"
SCHEMA = f"query_id long, place int, doc_id long, sentence_id int, score double, regions array<struct<{', '.join(x.replace(' ', ':', 1) for x in REGION.split(', ')).replace(', ', ',')}>>, omitted array<string>"


def regions(found: DataFrame, sentences: DataFrame, needle: DataFrame, cutoff: int = 5, docs: DataFrame | None = None) -> DataFrame:
    """Runs of text around and between matched tokens, and the needle tokens that nothing matched.

    From ten tokens before the match to ten after it, over sentence borders, cut from the texts of docs. A run ends
    where the next token starts, or with the text. Text between matched tokens carries the gap cost of what it skips,
    text before the first has no cost. Matched tokens carry the similarity, weight and origin (the metric that gave
    the similarity) of found, where it has them. Without docs, sentences joined by line feeds stand for the text.
    """
    wanted = found.select("doc_id").distinct()
    own = sentences.join(F.broadcast(wanted), "doc_id", "left_semi")
    if docs is None:
        lines = F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "sentence"))), lambda x: x["sentence"])
        texts = own.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))
    else:
        texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi")
    # parts are tokens and what stands between them; places has the part of each token of the lower-cased text
    parts = texts.select("doc_id", F.regexp_extract_all("text", F.lit(T.PIECE), F.lit(0)).alias("parts"))
    places = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i, F.size(T.token_array(p)))))
    parts = parts.withColumn("places", places)
    at = sentence_table(own).select("doc_id", "sentence_id", "token_at")
    words = needle.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("t_pos", "t_token", "weight", "pos"))).alias("needle"))
    rows = found.join(own.select("doc_id", "sentence_id", "tokens", "n_tokens", "max_len_s"), ["doc_id", "sentence_id"])
    rows = rows.join(at, ["doc_id", "sentence_id"]).join(parts, "doc_id").join(words, "query_id")
    rows = rows.withColumn("low", F.greatest(F.lit(0), F.col("token_at") - CONTEXT).cast("int"))
    size = (F.col("token_at") + F.col("n_tokens") + CONTEXT + 1 - F.col("low")).cast("int")
    rows = rows.withColumn("starts", F.slice("places", F.col("low") + 1, size))
    first, last = F.col("starts")[0], F.element_at("starts", -1)
    whole = F.size("starts") < size
    rows = rows.withColumn("ends", F.when(whole, F.size("parts")).otherwise(last))
    rows = rows.withColumn("parts", F.slice("parts", first + 1, F.col("ends") - first))
    rows = rows.withColumn("starts", F.transform("starts", lambda x: x - F.col("starts")[0]))
    rows = rows.withColumn("shift", (F.col("token_at") - F.col("low")).cast("int")).withColumn("pos", F.transform("tokens", T.universal_pos))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_drawn(r, cutoff) for r in batch.to_dict("records")], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    told = [c for c in ("weights", "origins") if c in found.columns]
    columns = ["query_id", "place", "doc_id", "sentence_id", "score", "match", "similarities", *told, "pos", "max_len_s", "parts", "starts", "shift", "needle"]
    return rows.select(columns).mapInPandas(draw, SCHEMA)


def _text(text: str, penalty=None) -> dict:
    return dict.fromkeys(("t", "similarity", "weight", "pos_s", "pos_t", "metric")) | {"s": text, "mismatch_penalty": penalty}


def _drawn(r: dict, cutoff: int) -> tuple:
    """starts: where the tokens of the window begin in parts, its first token being ``shift`` before the sentence."""
    parts, starts, shift = list(r["parts"]), [int(x) for x in r["starts"]], int(r["shift"])
    cut = lambda a, b: "".join(parts[starts[a] : starts[b] if b < len(starts) else len(parts)])
    costs = gap_costs(len(starts) + 1, cutoff, max(int(r["max_len_s"]), 1))
    pairs = [(int(u) + shift, v) for v, u in enumerate(r["match"]) if u >= 0]
    out: list[dict] = []
    last = max(0, pairs[0][0] - CONTEXT) if pairs else 0
    for k, (u, v) in enumerate(pairs):
        if u > last:
            out.append(_text(cut(last, u), float(costs[u - last]) if k else 0.0))
        t = r["needle"][v]
        out.append({
            "s": parts[starts[u]], "mismatch_penalty": None, "t": t["t_token"], "similarity": float(r["similarities"][v]),
            "weight": float(r["weights"][v] if "weights" in r else t["weight"]), "pos_s": r["pos"][u - shift], "pos_t": t["pos"],
            "metric": r["origins"][v] if "origins" in r else None,
        })
        last = max(last, u + 1)
    if pairs and last < len(starts):
        out.append(_text(cut(last, last + CONTEXT)))
    omitted = [t["t_token"] for t, u in zip(r["needle"], r["match"], strict=True) if u < 0]
    return r["query_id"], r["place"], r["doc_id"], r["sentence_id"], r["score"], out, omitted


def located(found: DataFrame, places: DataFrame, documents: DataFrame) -> DataFrame:
    """found with ``location``, a struct of speaker, author, work and a description of the place.

    places(doc_id, sentence_id, book, chapter, speaker, location) tells where sentences stand, and
    documents(doc_id, author, title, speakers) who wrote and who speaks. Only results come here.
    """
    at = places.select("doc_id", "sentence_id", "book", "chapter", "speaker", F.col("location").alias("_line"))
    rows = found.join(at, ["doc_id", "sentence_id"], "left").join(documents.select("doc_id", "author", "title", "speakers"), "doc_id", "left")
    speaker = F.coalesce(F.try_element_at("speakers", F.col("speaker")), F.lit(""))
    place = T.location(F.col("book"), F.col("chapter"), F.col("speaker"), F.col("_line"))
    told = F.struct(speaker.alias("speaker"), "author", F.col("title").alias("work"), place.alias("location"))
    return rows.withColumn("location", told).drop("book", "chapter", "speaker", "_line", "author", "title", "speakers")
