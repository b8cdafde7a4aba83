"""Near-duplicate documents by one-permutation hashing.

1. Every text becomes its set of word shingles (64-bit hashes) and a signature of ``bands * rows`` bins: the range of
   the hashes is cut into bins and each bin keeps its least member. Empty bins are filled by optimal densification:
   bin i asks bins h(i, 1), h(i, 2), ... and takes the first that is not empty, the same ones for every text.
2. Texts with equal sets are one class, and classes alone are compared. A class has a number (``node``), so rows with
   repeated or null ids are documents like any others.
3. Classes fall into banded buckets. A bucket of n gives n - 1 edges, all from its smallest node, so pairs grow with
   the rows and not with the square of a bucket. Edges whose signatures or sizes rule the link out are dropped, the
   rest are confirmed on the full sets.
4. Stars miss links between two members when only one of them is linked to the centre. Buckets that still hold more
   than one component are therefore searched inside: their members are dealt into tiles, each pair of different
   components is looked at in the first bucket that both share, and what sizes and sketches leave is confirmed on the
   full sets within the tile. Out of a tile come links of a spanning forest alone, one row for each component that it
   joins, and never the pairs. Buckets of one tile are then done; larger ones that are still mixed are finished
   across tiles, where only members outside the bucket's largest component visit other tiles.

The sketch that rules pairs out is the signature with 8 bits of each bin; ``SIGMAS`` standard deviations are allowed
for, and sets of less than ``SMALL`` shingles are never ruled out by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, free, grouped_runs, read, saved

CACHE_WORDS = 200_000
CHUNK = 500
SIGMAS = 5
SMALL = 32
TILE = 512
AT_ONCE = 1 << 18  # edges, 4 MB
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Shingler:
    """The sorted distinct shingle hashes of a text."""

    def __init__(self, words: int):
        self.words = words
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, np.uint64)

    def learn(self, words: set[bytes]) -> None:
        if len(self.number) > CACHE_WORDS:
            self.__init__(self.words)
        new = [x for x in words if x not in self.number]
        start = len(self.number)
        while start + len(new) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        for k, word in enumerate(new, start):
            self.number[word] = k
            self.hashes[k] = xxhash.xxh3_64_intdigest(word)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
        if not words:
            return np.zeros(0, np.uint64)
        distinct = set(words)
        if not distinct <= self.number.keys():
            self.learn(distinct)
        hashes = self.hashes[list(map(self.number.__getitem__, words))]
        n = min(self.words, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out ^= hashes[k : len(words) - n + 1 + k]
            out *= np.uint64(MULTIPLIERS[k % 3])
            out ^= out >> np.uint64(29)
        return np.unique(out)


def densification(bins: int, seed: int = 11) -> np.ndarray:
    """attempts[k, i]: the bin that an empty bin i asks in attempt k."""
    return np.random.default_rng(seed).integers(0, bins, (64 * max(1, bins.bit_length()), bins))


def signature(hashes: np.ndarray, bins: int, attempts: np.ndarray) -> np.ndarray:
    """hashes: sorted and not empty."""
    own = (hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    places = own[first].astype(np.int64)
    out[places] = hashes[first]
    full[places] = True
    empty = np.flatnonzero(~full)
    for asked in attempts:
        if not len(empty):
            break
        source = asked[empty]
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    out[empty] = hashes[0]
    return out


def bands_for(percent: int, rows: int, miss: float) -> int:
    """So many bands that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band, mixed from its rows and its number."""
    rows = sig.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(MULTIPLIERS[0])
    for column in rows.T:
        out ^= column
        out *= np.uint64(MULTIPLIERS[1])
        out ^= out >> np.uint64(31)
    return out * np.uint64(MULTIPLIERS[2])


SKETCH = "doc_id long, th long, n long, digest binary, sig binary, keys array<long>"


ROW = ["o", "th"]


def row_key() -> dict:
    """Columns that tell a row by its id (null as the least long) and a hash of its text, never null themselves."""
    return {"o": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64(F.coalesce("text", F.lit("")))}


def sketch(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """doc_id, th, n, digest of the set, a sketch, and the keys of its bands; nulls where the set is empty."""
    bins = rows * bands

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, attempts = Shingler(words), densification(bins)
        for batch in batches:
            out = []
            for text in batch["text"]:
                hashes = shingles(text)
                if not len(hashes):
                    out.append((0, None, None, None))
                    continue
                sig = signature(hashes, bins, attempts)
                short = (sig >> np.uint64(7)).astype(np.uint8)
                out.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), short.tobytes(), band_keys(sig, bands).view(np.int64)))
            made = pd.DataFrame(out, columns=["n", "digest", "sig", "keys"])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            made.insert(1, "th", batch["th"])
            yield made

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(row_key())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "th", "text").mapInPandas(run, SKETCH)


def matrix(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def allowed_for(percent: int, bins: int) -> float:
    """The least share of equal sketch bins that a link can be expected to have."""
    share = percent / 100
    return max(0.0, share - SIGMAS * math.sqrt(share * (1 - share) / bins))


def possible(edges: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that sizes and sketches do not rule out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    rows = edges.join(right, "b").join(left, "a")
    rows = rows.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", F.least("na", "nb").alias("n"), "sa", "sb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = matrix(batch["sa"], np.uint8), matrix(batch["sb"], np.uint8)
                yield batch.loc[((x == y).mean(axis=1) >= allowed_for(percent, x.shape[1])) | (batch["n"].to_numpy() < SMALL), ["a", "b"]]

    return rows.mapInPandas(run, "a long, b long")


MARK_WORDS = 1 << 20


def marked(rows: DataFrame) -> np.ndarray:
    """Words of 64 bits, with a bit set for each row key: about 16 bits a row as long as MARK_WORDS allows."""
    words = 1 << min(MARK_WORDS.bit_length() - 1, max(6, (rows.count() >> 2).bit_length()))
    hashed = F.xxhash64(*ROW)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(64)).cast("int"))
    found = rows.groupBy(F.pmod(hashed, F.lit(words)).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def only_marked(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows whose key is marked, and a few others."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def is_marked(hashed: pd.Series) -> pd.Series:
        h = hashed.to_numpy().view(np.uint64)
        word = shared.value[(h % np.uint64(len(shared.value))).astype(np.int64)]
        return pd.Series(word >> (h >> np.uint64(32)) % np.uint64(64) & np.uint64(1) > 0)

    return texts.where(is_marked(F.xxhash64(*ROW)))


def sets_of(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, members) for nodes(node, doc_id, th): the sorted shingle hashes, from the text of the row that stands for it.

    Texts of other rows are left out by a bitmap where they are read, so they do not move.
    """
    known = nodes.select("node", row_key()["o"].alias("o"), "th")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(row_key()).drop("doc_id")
    texts = only_marked(texts, marked(known)).join(known, ROW).dropDuplicates([*ROW, "node"]).select("node", "text")  # rows that are wholly alike

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(words)
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "members": [shingles(x).tobytes() for x in batch["text"]]})

    return texts.mapInPandas(shingle, "node long, members binary")


def similar(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Sorted sets: 100 * intersection >= percent * union."""
    if len(own) < len(other):
        own, other = other, own
    if not len(other) or 100 * len(other) < percent * len(own):
        return False
    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
    both = int((own[at] == other).sum())
    return 100 * both >= percent * (len(own) + len(other) - both)


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose full sets are similar enough. A hub's partners stream past its set, in parts of about CHUNK."""
    degree = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    partners = edges.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    partners = partners.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", F.col("b").alias("node"), F.lit(1).alias("is_b"), "members")
    hubs = degree.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    hubs = hubs.join(sets.withColumnRenamed("node", "a"), "a").select("a", "part", F.col("a").alias("node"), F.lit(0).alias("is_b"), "members")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, None
        for batch in batches:
            out = []
            for a, node, is_b, members in zip(batch["a"], batch["node"], batch["is_b"], batch["members"], strict=True):
                if not is_b:
                    hub, own = a, np.frombuffer(members, np.uint64)
                elif a == hub and similar(own, np.frombuffer(members, np.uint64), percent):
                    out.append((a, node))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = partners.unionByName(hubs).repartition("a", "part").sortWithinPartitions("a", "part", "is_b")
    return rows.mapInPandas(compare, "a long, b long")


class Forest:
    """Union-find over numbers 0..n-1."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.root[max(x, y)] = min(x, y)
        return True


def candidates(rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, partners): pairs of a tile that may be linked, by row numbers; each pair once.

    Both ends lie in different components, and this bucket is the first that both have. Rows with ``visit`` true have
    come from another tile: they meet the others only, and of those outside the bucket's largest component only the
    ones whose tile is the greater.
    """
    sig, keys = matrix(rows["sig"], np.uint8), np.stack(rows["keys"].to_list())
    comp, n, band, visit, own, top = (rows[x].to_numpy() for x in ("comp", "n", "band", "visit", "own", "top"))
    floor = allowed_for(percent, sig.shape[1])
    at_home = np.flatnonzero(~visit)
    crossing = visit.any()
    for k in np.flatnonzero(visit) if crossing else range(len(rows)):
        to = at_home if crossing else at_home[k + 1 :]
        ok = (comp[to] != comp[k]) & (100 * np.minimum(n[to], n[k]) >= percent * np.maximum(n[to], n[k]))
        if crossing:
            ok &= top[to] | (own[to] > own[k])
        to = to[ok]
        if len(to) and band[k]:
            to = to[~(keys[to, : band[k]] == keys[k, : band[k]]).any(axis=1)]
        if len(to):
            to = to[((sig[to] == sig[k]).mean(axis=1) >= floor) | (np.minimum(n[to], n[k]) < SMALL)]
        if len(to):
            yield int(k), to


TILE_KEYS = ["key", "i", "j"]


def worth_a_look(tiles: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, part, node) for the members of a tile that have a candidate; part numbers what candidates connect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in grouped_runs(batches, TILE_KEYS):
            forest, seen = Forest(len(rows)), set()
            for k, to in candidates(rows, percent):
                seen.add(k)
                seen.update(to.tolist())
                for x in to.tolist():
                    forest.join(k, x)
            if seen:
                found = sorted(seen)
                out = rows.iloc[found][[*TILE_KEYS, "node"]]
                out.insert(3, "part", [forest.find(x) for x in found])
                yield out

    rows = tiles.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)
    return rows.mapInPandas(run, "key long, i long, j long, part long, node long")


def linked_in_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a spanning forest over the components of each part of a tile, confirmed on full sets."""
    keys = [*TILE_KEYS, "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in grouped_runs(batches, keys):
            sets = [np.frombuffer(x, np.uint64) for x in rows["members"]]
            number = {c: k for k, c in enumerate(rows["comp"].unique())}
            comp = [number[c] for c in rows["comp"]]
            node = rows["node"].to_numpy()
            forest, out = Forest(len(number)), []
            for k, to in candidates(rows, percent):
                for x in to.tolist():
                    if forest.find(comp[k]) != forest.find(comp[x]) and similar(sets[k], sets[x], percent):
                        forest.join(comp[k], comp[x])
                        out.append((node[k], node[x]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def mixed_buckets(inside: DataFrame, found: DataFrame, nodes: DataFrame, crossing: bool) -> DataFrame:
    """Members of buckets that hold several components, dealt into tiles: key, i, j, node, comp, n, sig, keys, band, ...

    Within tiles, i = j is a member's own tile. Across tiles, members outside the bucket's largest component (``top``
    false) are visitors: they come in groups of about TILE (i) to every tile (j) but their own.
    """
    comp = F.coalesce("component_id", "node").alias("comp")
    placed = inside.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("key", "band", "n_key", "node", comp)
    if crossing:
        placed = placed.where(F.col("n_key") > TILE)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    placed = placed.join(mixed, "key")
    placed = placed.withColumn("t", F.ceil(F.col("n_key") / TILE)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("t")))
    home = placed.withColumns({"visit": F.lit(False), "j": F.col("own")})
    if not crossing:
        tiles = home.withColumns({"i": F.col("own"), "top": F.lit(False)})
    else:
        sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("all"))
        groups = F.ceil((F.col("all") - F.col("most.c")) / TILE)
        largest = largest.select("key", F.col("most.comp").alias("largest"), groups.alias("groups"))
        home = home.join(largest, "key").withColumn("top", F.col("comp") == F.col("largest"))
        guests = home.where("NOT top").withColumns({"visit": F.lit(True), "i": F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups"))})
        guests = guests.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1))).where("j <> own")
        home = home.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        tiles = home.unionByName(guests)
    return tiles.select(*TILE_KEYS, "band", "node", "comp", "own", "visit", "top").join(nodes.select("node", "n", "sig", "keys"), "node")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, leads) for each row; th is a hash of the text.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. A text with fewer words
    is one shingle; null, empty and blank texts have no shingle and link with nothing. Every row is a document of its
    own, whatever its id. component_id is the smallest doc_id of a component, null if no row of it has one; ``leads``
    is true for the rows with the smallest (doc_id, th) of their component, null ids last, and for rows that link with
    nothing. An empty table gives no rows; other columns are ignored. The result is a stored table.
    """
    bands = bands_for(percent, rows, miss)
    table = saved(sketch(docs, words, rows, bands), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    classes = table.where("n > 0").groupBy("digest", "n", "sig", "keys").agg(F.min(order).alias("lead"))
    nodes = saved(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "sig", "keys", "lead"), "nodes")
    with_text = nodes.select("node", "lead.doc_id", "lead.th")

    buckets = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n_key")).where("n_key > 1")
    inside = saved(buckets.join(shared, "key"), "members")
    stars = inside.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tested = saved(possible(stars, nodes, percent), "stars")
    asked = tested.select(F.col("a").alias("node")).union(tested.select(F.col("b").alias("node"))).distinct()
    sets = saved(sets_of(with_text.join(asked, "node", "left_semi"), docs, words), "sets")
    links = saved(confirmed(tested, sets, percent), "links")
    found = components(links, at_once=AT_ONCE)
    spent = [inside, tested, sets, links]

    for crossing in (False, True):
        tiles = saved(mixed_buckets(inside, found, nodes, crossing), "tiles")
        seen = saved(worth_a_look(tiles, percent), "seen")
        if not seen.isEmpty():
            lacking = seen.select("node").distinct().join(sets.select("node"), "node", "left_anti")
            more = saved(sets_of(with_text.join(lacking, "node", "left_semi"), docs, words), "sets")
            spent.append(more)
            sets = sets.union(more)
            look = tiles.join(seen, [*TILE_KEYS, "node"]).join(sets, "node")
            new = saved(linked_in_tiles(look, percent), "links")
            spent.append(new)
            if not new.isEmpty():
                links = links.union(new)
                spent.append(found)
                found = components(links, at_once=AT_ONCE)
        spent += [tiles, seen]
    free(*spent)

    of_node = nodes.select("node", "digest", "lead").join(found, "node", "left").select("digest", "lead", F.coalesce("component_id", "node").alias("comp"))
    heads = of_node.groupBy("comp").agg(F.min("lead").alias("head"))
    of_class = of_node.join(heads, "comp").select("digest", "head")
    named = table.select("doc_id", "th", F.col("n").alias("n_shingles"), "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    leads = F.when(F.col("n_shingles") > 0, F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))).otherwise(True)
    groups = saved(named.select("doc_id", "th", "n_shingles", component.alias("component_id"), leads.alias("leads")), "groups")
    free(table, nodes, found)  # on disk, sketches and keys are half as large as the texts
    return groups


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row, as ``near_groups`` has them.

    kept says that the row's id is its component's; rows with a null id are kept only where they lead.
    """
    found = near_groups(docs, words, percent, rows, miss)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), "leads").alias("kept"))


def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
