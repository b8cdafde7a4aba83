"""What the operators share: scratch tables, text columns, distributed ranks and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a session in one process (``local[...]``), as in tests, may name none: then a local folder will do. On a
    cluster a missing setting is an error, since executors could not read what others wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended; the folder belongs to the cluster's scratch space
        pass


_meanwhile: list[list[Callable[[], None]]] = []


def at_end(forget: Callable, *what) -> None:
    """Call forget(*what) when the driver ends, unless whoever asks with ``stored_meanwhile`` does before."""
    atexit.register(forget, *what)
    if _meanwhile:
        _meanwhile[-1].append(partial(forget, *what))


@contextmanager
def stored_meanwhile() -> Iterator[list[Callable[[], None]]]:
    """What deletes the frames and tables stored inside, one function for each, in the order of storing.

    To be called as soon as nothing that is still to be computed reads them.
    """
    made: list[Callable[[], None]] = []
    _meanwhile.append(made)
    try:
        yield made
    finally:
        _meanwhile.pop()


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it has been written, not when the driver next collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and no executor is needed to keep it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path, compression="zstd")
    at_end(_forget, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def free(*frames: DataFrame) -> None:
    """Delete the files of stored frames; nothing that is still to be computed may read them."""
    for df in frames:
        _forget(df.sparkSession, df.scratch_path)


def grouped_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """All rows of one key after another, from batches in order of the keys. Holds one batch and one key's rows."""
    pending: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if pending and any(pending[-1][k].iloc[-1] != c[0] for k, c in zip(keys, columns, strict=True)):
            yield _whole(pending)
            pending = []
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a and pending:
                yield _whole(pending)
                pending = []
            pending.append(batch.iloc[a:b])
    if pending:
        yield _whole(pending)


def _whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def ranked(df: DataFrame, group: str, order: list[str], rows_per_salt: int = 1000, few_groups: bool = False) -> DataFrame:
    """df with ``rank``, 0-based and gapless within each group, without one task for one group.

    Each group is dealt by a hash of the order columns into as many salts as its own size asks for; counts by
    (group, salt) give each salt the place where it starts, and a window numbers the rows of a salt. Rows of equal
    order columns rank in any order. df is read several times, so it should be a stored table. few_groups says that
    the number of groups is bounded by a parameter, so that their sizes can go to all executors.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).alias("_salts"))
    dealt = df.join(F.broadcast(sizes) if few_groups else sizes, group).withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts"))).drop("_salts")
    counts = dealt.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(group, "_salt").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, [group, "_salt"])
        .withColumn("rank", (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_salt", "_row", "_start")
    )


def joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges x-y in order, and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = place[: len(x)], place[len(x) :]
    root = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(root[x] != root[y])):
        u, v = root[x[open_]], root[y[open_]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = 0) -> DataFrame:
    """(node, component_id) for every node of the undirected edges; component_id is the smallest node reachable.

    Alternating large-star and small-star rounds: neighbours are never gathered, only their minimum is taken, so a
    hub is a partial aggregate and a join whose skew Spark can split. Each round is stored in place of the one before,
    and the rounds end when the edges are all stars around the smallest node. The result is a stored table.

    As few as ``at_once`` edges are joined by the driver instead: the plans and tasks of the rounds, of which the
    driver keeps a record, would take more of its memory than the edges do.
    """
    spark = edges.sparkSession
    if at_once and edges.count() <= at_once:
        few = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").toArrow()
        node, least = joined(few["a"].to_numpy(), few["b"].to_numpy())
        found = pd.DataFrame({"node": node, "component_id": least}, dtype="int64")
        return saved(spark.createDataFrame(found, "node long, component_id long"), "components")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    source = now = saved(now, "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        last, now = source, saved(now.where("u > v").distinct(), "stars")
        free(last)
        source = now
        state = now.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if state == before:
            break
        before = state
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    named = saved(spark.createDataFrame([], "node long, component_id long").union(found).union(roots), "components")
    free(source)
    return named
