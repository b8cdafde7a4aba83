"""Documents that keep arriving: incremental ingest and a running top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Parse new documents only; what was parsed before is known to the checkpoint."""
    return parse(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(kept: DataFrame | None, new: DataFrame, k: int = 100) -> DataFrame:
    """The k best rows of each query of both."""
    rows = new if kept is None else kept.unionByName(new)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"), F.desc("sentence_id")))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")


def progressive_search(stream: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, k: int = 100, total_tokens: int = 0):
    """Each batch's results are merged with those so far and written under the batch's number.

    Beside them stands the progress: tokens searched so far, counted in passing, and their share of total_tokens (0 if
    that is not told).
    """

    def batch(docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        kept = spark.read.parquet(f"{path}/{number - 1}") if number else None
        before = spark.read.json(f"{path}-progress/{number - 1}").first()["done"] if number else 0
        passed = Observation()
        counted = docs.observe(passed, F.sum(F.coalesce(F.size(T.token_array(F.col("text"))), F.lit(0))).alias("n"))
        merged(kept, search(counted), k).write.mode("overwrite").parquet(f"{path}/{number}")
        done = before + (passed.get["n"] or 0)
        row = [(number, done, done / total_tokens if total_tokens else 0.0)]
        spark.createDataFrame(row, "batch long, done long, progress double").coalesce(1).write.mode("overwrite").json(f"{path}-progress/{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def begin(spark: SparkSession, session: str) -> None:
    """A session has one search at a time: what it still has running is stopped, and what starts now is its own."""
    abort(spark, session)
    spark.sparkContext.addJobTag(session)


def abort(spark: SparkSession, tag: str) -> None:
    """Stop all jobs that threads have started under a tag since ``begin`` or ``SparkContext.addJobTag``."""
    spark.sparkContext.cancelJobsWithTag(tag)
