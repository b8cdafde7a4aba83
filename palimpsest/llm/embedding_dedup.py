"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of length 1 with cosine >= t lie within squared distance 2 - 2t. Turned by one random rotation and cut into
blocks of a few dimensions, two such vectors are, in one block at least, within that block's share of the budget (the
share is the block's part of the dimensions). So each block is range-joined by itself: a k-d tree over the block, grown
on a bounded sample and descended as deep as the size of a vector's own label asks for, sends the vector to its leaf and
to every other leaf nearer than the block's radius. Within a leaf, pairs inside the block's budget are verified on the full vectors in
double precision; a pair counts in the first block that proposes it alone, so the union of candidates needs no
distinct. A leaf's home rows meet all its rows; leaves with many rows (a cluster cannot be split by planes) are compared
tile by tile in tasks of their own. Links leave a tile as counts and as stars, never as all pairs. Equal vectors are joined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, saved

BLOCK = 8
SAMPLE = 20_000
DEEPEST = 14
LEAF_ROWS = 2048
TILE = 8192
SLACK = 1e-6
Tree = tuple  # () for a leaf, or (axis, cut, lower, upper)


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def grow(points: np.ndarray, depth: int) -> Tree:
    if depth == 0 or len(points) < 2:
        return ()
    axis = int(points.std(axis=0).argmax())
    cut = float(np.median(points[:, axis]))
    low = points[:, axis] < cut
    if not low.any():
        return ()
    return (axis, cut, grow(points[low], depth - 1), grow(points[~low], depth - 1))


def leaves(tree: Tree, points: np.ndarray, radius: float, depth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows, home): the rows within radius of each leaf, and whether they lie in it. Rows descend to their own depth."""
    todo = [(tree, 1, 0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, leaf, level, rows, home = todo.pop()
        ends = depth[rows] <= level if node else np.ones(len(rows), bool)
        if ends.any():
            yield leaf, rows[ends], home[ends]
        rows, home = rows[~ends], home[~ends]
        if not len(rows):
            continue
        axis, cut, lower, upper = node
        x = points[rows, axis]
        low, high = x < cut + radius, x >= cut - radius
        todo.append((lower, 2 * leaf, level + 1, rows[low], home[low] & (x[low] < cut)))
        todo.append((upper, 2 * leaf + 1, level + 1, rows[high], home[high] & (x[high] >= cut)))


def unit_vectors(column) -> np.ndarray:
    """Vectors at length 1. The largest component is made 1 first, so that no square over- or underflows."""
    vectors = np.array([np.asarray(v, dtype=np.float64) for v in column])
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def connect(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give linked places the least label of both, until all that are connected have one; label[k] <= k."""
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            return
        low = np.minimum(p, q)
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def link_tile(left: pd.DataFrame, right: pd.DataFrame, block: int, cosine: float, turn: np.ndarray) -> pd.DataFrame:
    """Links of left rows, at home here, to right rows with greater ids: for each row its links, weighted by copies, and stars.

    The smaller id of a pair is at home in one leaf of a block alone, and of the blocks that would propose a pair the
    first one counts it, so every pair is counted once.
    """
    a, b = unit_vectors(left["embedding"]), unit_vectors(right["embedding"])
    ids_a, ids_b = left["rep"].to_numpy(), right["rep"].to_numpy()
    many_a, many_b = left["copies"].to_numpy(), right["copies"].to_numpy()
    budget = (2 - 2 * cosine) / a.shape[1]
    turned_a, turned_b = a @ turn, b @ turn
    ends = [*range(0, a.shape[1], BLOCK), a.shape[1]]
    parts = [slice(x, y) for x, y in zip(ends, ends[1:], strict=False)]
    links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ids = np.unique(np.concatenate([ids_a, ids_b]))
    at_a, at_b = np.searchsorted(ids, ids_a), np.searchsorted(ids, ids_b)
    label = np.arange(len(ids))
    part = parts[block]
    squares = (turned_b[:, part] ** 2).sum(axis=1)[None]
    for at in range(0, len(a), 256):
        p = turned_a[at : at + 256, part]
        apart = (p * p).sum(axis=1)[:, None] + squares - 2 * p @ turned_b[:, part].T
        hit = apart <= budget * (part.stop - part.start) + 2 * SLACK
        hit &= ids_a[at : at + 256][:, None] < ids_b[None]
        i, j = np.nonzero(hit)
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000] + at, j[k : k + 100_000]
            ok = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            x, y = x[ok], y[ok]
            first = np.ones(len(x), bool)
            for k_, other in enumerate(parts[: block + 1]):
                gap = turned_a[x][:, other] - turned_b[y][:, other]
                inside = (gap * gap).sum(axis=1) <= budget * (other.stop - other.start) + SLACK
                first &= inside if k_ == block else ~inside
            x, y = x[first], y[first]
            np.add.at(links_a, x, many_b[y])
            np.add.at(links_b, y, many_a[x])
            connect(label, at_a[x], at_b[y])
    counts = pd.DataFrame({"rep": np.concatenate([ids_a, ids_b]), "links": np.concatenate([links_a, links_b]), "to": -1, "kind": 0})
    joined = np.flatnonzero(label != np.arange(len(ids)))
    stars = pd.DataFrame({"rep": ids[joined], "links": 0, "to": ids[label[joined]], "kind": 1})
    return pd.concat([counts[counts["links"] > 0], stars], ignore_index=True).astype("int64")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; only vectors of one label, not null, are compared.

    Null, empty and zero vectors, those with a null or non-finite component, and rows with a null vec_id or label
    link with nothing. Vectors of different dimensions are not compared. Rows of one vec_id are one vector each, with
    the component that their equal vectors have. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ok = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    )
    rows = vectors.select("vec_id", "label", "embedding").withColumn("ok", F.coalesce(ok, F.lit(False)))
    classes = saved(rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    results = []
    for (dims,) in classes.select(F.size("embedding")).distinct().collect():
        results.append(_joined(classes.where(F.size("embedding") == dims), dims, cosine))
    schema = "rep long, links long, to long, kind long"
    found = spark.createDataFrame([], schema)
    for x in results:
        found = found.union(x)
    found = saved(found, "links")  # n_links and a path to the least id for every linked vector
    counts = found.where("kind = 0").groupBy("rep").agg(F.sum("links").alias("links"))
    stars = components(found.where("kind = 1"), "rep", "to").withColumnRenamed("node", "rep")
    of_class = classes.join(counts, "rep", "left").join(stars, "rep", "left")
    of_class = of_class.select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    named = rows.where("ok").join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _joined(classes: DataFrame, dims: int, cosine: float) -> DataFrame:
    turn = rotation(dims)
    blocks = -(-dims // BLOCK)
    n = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, n // SAMPLE))) == 0).select("embedding").limit(2 * SAMPLE)
    points = unit_vectors([r["embedding"] for r in sample.collect()] or [np.ones(dims)]) @ turn
    # each label goes as deep as its own size asks for
    depth = F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.ceil(F.log2(F.count(F.lit(1)) / LEAF_ROWS)))).cast("int")
    depths = saved(classes.groupBy("label").agg(depth.alias("depth")), "depths")
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    width = [min(BLOCK, dims - BLOCK * k) for k in range(blocks)]
    radius = [float(np.sqrt((2 - 2 * cosine) * w / dims + 2 * SLACK)) for w in width]
    trees = [grow(points[:, BLOCK * k : BLOCK * k + w], deepest) for k, w in enumerate(width)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            turned = unit_vectors(batch["embedding"]) @ turn
            own_depth = batch["depth"].to_numpy()
            batch = batch.drop(columns="depth")
            for k, w in enumerate(width):
                for leaf, own, home in leaves(trees[k], turned[:, BLOCK * k : BLOCK * k + w], radius[k], own_depth):
                    yield batch.iloc[own].assign(block=k, leaf=leaf, home=home)

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"label {kinds['label']}, embedding {kinds['embedding']}, rep long, copies long, block int, leaf long, home boolean"
    placed = classes.join(depths, "label").select("label", "embedding", "rep", "copies", "depth")
    sent = saved(placed.mapInPandas(send, schema), "leaves")
    # a leaf is one task, or the tiles of its home rows (i) against those of all its rows (j)
    key = ["label", "block", "leaf"]
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE))
    sizes = sent.groupBy(*key).agg(tiles(F.sum(F.col("home").cast("int"))).alias("lefts"), tiles(F.count(F.lit(1))).alias("rights"))
    rows = sent.join(sizes, key).withColumns({"own_i": F.pmod(F.xxhash64("rep"), F.col("lefts")), "own_j": F.pmod(F.xxhash64("rep"), F.col("rights"))})
    as_right = "transform(sequence(0L, lefts - 1), i -> struct(i AS i, own_j AS j))"
    as_left = "if(home, transform(sequence(0L, rights - 1), j -> struct(own_i AS i, j AS j)), array())"
    rows = rows.withColumn("tile", F.explode(F.expr(f"array_union({as_right}, {as_left})"))).select("*", "tile.i", "tile.j")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["home"] & (rows["own_i"] == rows["i"])]
        right = rows[rows["own_j"] == rows["j"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "to": [], "kind": []}, dtype="int64")
        return link_tile(left.sort_values("rep"), right.sort_values("rep"), int(rows["block"].iloc[0]), cosine, turn)

    columns = [*key, "i", "j", "own_i", "own_j", "embedding", "rep", "copies", "home"]
    return rows.select(columns).groupBy(*key, "i", "j").applyInPandas(link, "rep long, links long, to long, kind long")


def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
