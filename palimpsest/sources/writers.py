"""Writing corpora and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(tokens: DataFrame, sentences: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """The tables of a corpus, once; what is there stays. documents has texts and metadata."""
    for name, rows in (("tokens", tokens), ("sentences", sentences), ("documents", documents)):
        if rows is not None:
            rows.write.mode("ignore").parquet(f"{path}/{name}.parquet")


def dump(signed: DataFrame, path: str) -> None:
    """One text block for each sentence, below the signatures of its document and its own, documents one after another."""
    block = F.concat(F.col("doc_signature"), F.lit("/"), F.col("signature"), F.lit("\n"), F.col("sentence"), F.lit("\n"))
    order = ["doc_signature", "sentence_id"]
    signed.repartitionByRange(*order).sortWithinPartitions(*order).select(block.alias("value")).write.mode("overwrite").text(path)


def write_evaluation(rows: DataFrame, path: str) -> None:
    """Semicolons between columns; a value that has not been computed is -1."""
    rows.fillna(-1.0, ["value"]).write.mode("overwrite").option("header", True).csv(path, sep=";")


def results_json(found: DataFrame) -> DataFrame:
    """One JSON document for each result."""
    return found.select("query_id", "place", F.to_json(F.struct(*[c for c in found.columns if c not in ("query_id", "place")])).alias("json"))


def html_table(best: DataFrame, limit: int = 1000) -> str:
    """A small table, such as the best parameters, as HTML."""
    return best.limit(limit).toPandas().to_html(index=False)
