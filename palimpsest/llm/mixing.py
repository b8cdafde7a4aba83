"""Mixing sources to target weights, by hash-threshold histograms.

A source's target is met by taking every document floor(target / size of the source) times and once more those whose
hash lies below the source's threshold. The threshold comes from sums by (source, hash bucket): the buckets before
the one in which the budget runs out are taken whole, that one is split by its next hash bits, and only what is left
of it after ``LEVELS`` splits (one row in 2**(BITS*LEVELS)) is looked at row by row. Nothing sorts the documents.

Null text counts no words; a null source is a source of its own and comes last; rows of one doc_id share a hash and
are taken together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, saved

HASH_BITS = 60
BITS = 12
LEVELS = 2
WORDS = r"[^\x20\x09-\x0D]+"


def unit_hash(doc_id: str = "doc_id") -> Column:
    """60 bits of the md5 of the id as text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes(source, source_size) with ``target``: one row for each source, so one window over all of them.

    Sorted by the level at which a source is full, the first k are full iff the level of the others stays below
    the next one's; this is where resharing the excess by weight ends.
    """
    in_order = W.orderBy(F.col("source").isNull(), "source")
    cases = F.expr("CASE pmod(_i, %d) %s END" % (len(weights), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))))
    full = W.orderBy("_full", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    out = (
        sizes.withColumn("_i", F.row_number().over(in_order) - 1)
        .withColumn("_w", cases)
        .withColumn("_full", F.lit(most) * F.col("source_size") / F.col("_w"))
        .withColumn("_free", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(full), F.lit(0)))
        .withColumn("_left", F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(full), F.lit(0)))
    )
    # the first in this order that stays below its limit sets the level for itself and all after it
    open_ = F.when(F.col("_left") / F.col("_free") <= F.col("_full"), F.struct("_full", F.col("source").isNull(), "source", "_left", "_free"))
    out = out.withColumn("_at", F.min(open_).over(everything))
    after = F.struct("_full", F.col("source").isNull(), "source") >= F.struct("_at._full", F.col("_at.col2"), F.col("_at.source"))
    level = F.when(F.col("_at").isNotNull() & after, F.col("_w") * F.col("_at._left") / F.col("_at._free"))
    return out.select("source", "source_size", F.coalesce(level, F.lit(most) * F.col("source_size")).alias("target"))


def source_key() -> Column:
    """The source as a join key: null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def units_of(docs: DataFrame) -> DataFrame:
    return saved(docs.select("doc_id", "source", n_words().alias("size"), unit_hash().alias("h")), "mix")


def mixing_plan(units: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(skey, source_size, target, base, t) for each source: its documents are taken ``base`` times, and once more if h < t."""
    key = source_key().alias("skey")
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(0)
    plan = targets.select(
        key, "source_size", "target", base.cast("long").alias("base"),
        (F.col("target") - base * F.col("source_size")).alias("need"),
    )
    plan = saved(plan, "targets")
    rows, open_, thresholds = units.select(key, "size", "h"), plan.select("skey", "need", F.lit(0).cast("long").alias("low")), []
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * level
        top = F.shiftright(F.col("h"), shift)
        sums = rows.groupBy("skey", top.alias("bucket")).agg(F.sum("size").alias("s"))
        upto = W.partitionBy("skey").orderBy("bucket")
        sums = sums.withColumn("after", F.sum("s").over(upto)).join(open_, "skey")
        per = sums.groupBy("skey", "need").agg(
            F.max(F.when(F.col("after") <= F.col("need"), F.struct("bucket", "after"))).alias("whole"),
            F.min(F.when((F.col("after") > F.col("need")) & (F.col("after") - F.col("s") < F.col("need")), F.struct("bucket", "after", "s"))).alias("split"),
            F.max("low").alias("low"),
        )
        per = saved(per, "level")
        ends = F.greatest(F.shiftleft(F.col("whole.bucket") + 1, shift), F.col("low"))
        thresholds.append(per.where("split IS NULL").select("skey", F.coalesce(ends, F.col("low")).alias("t")))
        open_ = per.where("split IS NOT NULL").select(
            "skey", (F.col("need") - (F.col("split.after") - F.col("split.s"))).alias("need"),
            F.shiftleft(F.col("split.bucket"), shift).alias("low"), F.col("split.bucket").alias("only"),
        )
        rows = rows.join(open_.select("skey", "only"), "skey").where(top == F.col("only")).drop("only")
        open_ = open_.drop("only")
    inside = W.partitionBy("skey").orderBy("h")
    last = (
        rows.groupBy("skey", "h").agg(F.sum("size").alias("s"))
        .withColumn("after", F.sum("s").over(inside)).join(open_, "skey")
        .groupBy("skey").agg(F.max(F.when(2 * F.col("after") - F.col("s") < 2 * F.col("need"), F.col("h") + 1)).alias("t"), F.max("low").alias("low"))
        .select("skey", F.coalesce("t", "low").alias("t"))
    )
    for x in thresholds:
        last = last.union(x)
    return saved(plan.join(last, "skey", "left").withColumn("t", F.coalesce("t", F.lit(0))).drop("need"), "plan")


def times() -> Column:
    return F.col("base") + F.when(F.col("h") < F.col("t"), 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): ``taken`` words of each document, repeats counted."""
    units = units_of(docs)
    rows = units.withColumn("skey", source_key()).join(mixing_plan(units, **options), "skey")
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, with all its columns whatever their names, every row as many times as the mix takes it; no text is shuffled."""
    plan = mixing_plan(units_of(docs), **options)
    rows = docs.select(F.struct("*").alias("row"), source_key().alias("skey"), unit_hash().alias("h")).join(plan, "skey")
    rows = rows.withColumn("times", times()).where("times > 0")
    return rows.select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH units AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT] AS w
  FROM units GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free,
         1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0) AS rest,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source) AS k
  FROM sizes
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT k, rest, free FROM levels WHERE rest / free <= full_at ORDER BY k LIMIT 1),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN lvl.k IS NOT NULL AND l.k >= lvl.k THEN l.w * lvl.rest / lvl.free ELSE 2.0::DOUBLE * l.source_size END AS target
  FROM levels l LEFT JOIN lvl ON true),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS need
  FROM targets),
placed AS (
  SELECT u.*, sum(size) OVER (PARTITION BY source ORDER BY h) AS after FROM units u)
SELECT p.doc_id, p.size, c.source_size, c.target::DOUBLE AS target,
       (p.size * (c.base + CASE WHEN 2 * p.after - p.size < 2 * c.need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p JOIN cut c ON p.source IS NOT DISTINCT FROM c.source
"""
