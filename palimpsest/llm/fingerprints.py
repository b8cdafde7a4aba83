"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame expressions alone.

A text is cut into paragraphs: pieces of a line that end with the first sentence after ``PIECE`` characters, or with the
word that passes twice as many; each has a digest. A sketch has three tables of ``SIDE`` cells; a digest goes into one cell of each,
where counts add up and keys and checks are xored. Subtracting two sketches cell by cell leaves the differing digests,
and peeling takes them out: a cell with one digest left gives it away, it is taken from its other cells, and so on, until
every differing digest and its side are known. If cells remain, the sketch was too small or unlucky. Then the digests
of both texts go into larger sketches of ``LARGE`` cells a table, one for about ``LOAD`` of them, and where one of those
fails into ``SPLIT`` more, with fresh bits each time. What fails ``LEVELS`` times over (a few times in a million, since
each larger sketch fails for about one pair in forty) is compared by set difference.

The fingerprint is the smallest sketch, written in hexadecimal. It tells how many digests a text has (the counts of a
table), so two fingerprints alone give the likeness of their texts wherever they peel: shared / (shared + differing),
1 if neither has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read

PIECE = 50
SIDE = 32
LARGE = 64
LOAD = 100
SPLIT = 4
LEVELS = 3
ROUNDS = 16
ROWS_PER_BUCKET = 512
QUANTILES = 256
EMPTY = "named_struct('c', 0, 'k', 0L, 'h', 0L)"
NONE = "CAST(array() AS ARRAY<BIGINT>)"


def digests(text: str, piece: int = PIECE) -> str:
    """62-bit digests, so that a digest and its side fit into one long."""
    pattern = f"[^\\\\n]{{1,{piece}}}[^\\\\n.!?]{{0,{piece}}}[^\\\\s.!?]*[.!?]*"
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), p -> xxhash64(p) & {(1 << 62) - 1}L))"


def check(k: str) -> str:
    return f"(xxhash64({k}, 1) & 4294967295L)"


def bound(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def side(level: int) -> int:
    return LARGE if level else SIDE


def tables(found: str, level: int, digest: str = "{}", count: str = "1") -> str:
    """The cells of the three tables of the elements of an array, one after another.

    A digest's places are told by other bits of it in each table, by other ones at the first two levels, and by those
    of another hash at each later one. Elements are sorted into cells in two steps, so in each table they are looked at
    about twice the root of its cells times.
    """
    high = 1 << ((side(level).bit_length() - 1) // 2)
    low = side(level) // high
    own = digest.format("d") if level < 2 else f"xxhash64({digest.format('d')}, {level})"
    out = []
    for n in range(3):
        at = 20 * n + 6 * (level == 1)
        bits = lambda shift, many: f"(shiftright({own}, {shift}) & {many - 1})" if shift else f"({own} & {many - 1})"
        cell = (
            f"aggregate(filter(part, d -> {bits(at + high.bit_length() - 1, low)} = low), {EMPTY}, (a, d) -> "
            f"named_struct('c', a.c + {count}, 'k', a.k ^ {digest.format('d')}, 'h', a.h ^ {check(digest.format('d'))}))"
        )
        every = f"if(size(part) = 0, array_repeat({EMPTY}, {low}), transform(sequence(0, {low - 1}), low -> {cell}))"
        inner = bound(f"filter({found}, d -> {bits(at, high)} = high)", "part", every)
        out.append(f"flatten(transform(sequence(0, {high - 1}), high -> {inner}))")
    return f"concat({', '.join(out)})"


def sketch(found: str, level: int = 0) -> str:
    return tables(found, level)


def subtract(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> if(y.c = 0 AND y.k = 0L, x, named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h)))"


def peel(cells: str, level: int = 0) -> str:
    """The digests that differ, or null if cells remain: each doubled, plus 1 for those of the left."""
    pure = f"array_distinct(transform(filter(s.cells, x -> abs(x.c) = 1 AND x.h = {check('x.k')}), x -> shiftleft(x.k, 1) + CAST(x.c = 1 AS BIGINT)))"
    rest = subtract("s.cells", tables("pure", level, "shiftright({}, 1)", "CAST(2 * (d & 1) - 1 AS INT)"))
    after = f"named_struct('cells', {rest}, 'out', concat(s.out, pure), 'stuck', false)"
    turn = bound(pure, "pure", f"if(size(pure) = 0, named_struct('cells', s.cells, 'out', s.out, 'stuck', true), {after})")
    start = f"named_struct('cells', {cells}, 'out', {NONE}, 'stuck', false)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(s.stuck, s, {turn}), s -> if(exists(s.cells, x -> x.c <> 0 OR x.k <> 0L), NULL, s.out))"


def difference(a: str, b: str, level: int = 1) -> str:
    """The digests that differ between arrays a and b, by sketches as large as they need; as ``peel`` gives them."""
    if level > LEVELS:
        return f"concat(transform(array_except({a}, {b}), k -> shiftleft(k, 1) + 1L), transform(array_except({b}, {a}), k -> shiftleft(k, 1)))"
    parts = f"CAST(ceil((size({a}) + size({b})) / {LOAD}.0D) AS INT)" if level == 1 else f"{SPLIT}"
    own = lambda x: f"if(n{level} = 1, {x}, filter({x}, d -> pmod(xxhash64(d, {level + 100}), n{level}) = i{level}))"
    left, right = f"p{level}.a", f"p{level}.b"
    tried = peel(subtract(sketch(left, level), sketch(right, level)), level)
    part = f"if({left} = {right}, {NONE}, coalesce({tried}, {difference(left, right, level + 1)}))"
    one = bound(f"named_struct('a', {own(a)}, 'b', {own(b)})", f"p{level}", part)
    each = bound(parts, f"n{level}", f"flatten(transform(sequence(0, n{level} - 1), i{level} -> {one}))")
    return f"if(size({a}) + size({b}) = 0, {NONE}, {each})"


def compared(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """``difference``, first by the fingerprints' own sketches, unless so few of their cells are empty that they cannot peel."""
    small = bound(subtract(sketch_a, sketch_b), "cells", f"if(size(filter(cells, x -> x.c = 0 AND x.k = 0L)) * 8 < {3 * SIDE}, NULL, {peel('cells')})")
    return f"coalesce({small}, {difference(a, b)})"


def likeness(a: str, b: str, d: str) -> str:
    both = f"(size({a}) + size({b}))"
    return f"if({both} = 0, 1.0D, CAST({both} - size({d}) AS DOUBLE) / ({both} + size({d})))"


def written(cells: str) -> str:
    return f"array_join(transform({cells}, x -> concat(lpad(hex(x.c), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 8, '0'))), '')"


def _bucket(docs: DataFrame) -> tuple[Column, int]:
    """A number that puts rows (o, th) in ascending order of o into buckets of about ROWS_PER_BUCKET, and the stride.

    Between two of the quantiles of o, buckets are even parts; an o that several quantiles share has places of its own,
    where rows are dealt by the range of th, which descends as the number grows. Numbers with one quotient by the stride
    stand between two quantiles or have one o, so quotients are few whatever the table holds.
    """
    n = docs.count()
    buckets = max(1, n // ROWS_PER_BUCKET)
    first = min(QUANTILES, buckets)
    if first == 1:
        return F.lit(0).cast("long"), 1
    bounds = docs.agg(F.percentile_approx("o", [k / first for k in range(first + 1)], 10_000)).first()[0]
    inner = sorted(set(bounds[1:-1]))

    def tree(lo: int, hi: int) -> Column:
        """The number of inner bounds at or below o, known to be lo to hi."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("o") < inner[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    between = tree(0, len(inner)).cast("long")
    parts = -(-buckets // first)
    shares = {v: -(-bounds.count(v) * n // (first * ROWS_PER_BUCKET)) for v in inner if bounds.count(v) > 1}
    stride = max(parts + 2, *shares.values()) if shares else parts + 2
    part = F.lit(0).cast("long")
    if parts > 1:
        ends = F.array(*[F.lit(x) for x in [bounds[0], *inner, bounds[-1] + 1]])
        low, high = F.get(ends, between.cast("int")), F.get(ends, between.cast("int") + 1)
        part = F.coalesce(F.width_bucket("o", low.cast("double"), high.cast("double"), F.lit(parts)), F.lit(0))
    number = 2 * between * stride + part
    if shares:
        many = F.try_element_at(F.create_map(*[x for v, m in shares.items() for x in (F.lit(v).cast("long"), F.lit(m).cast("long"))]), F.col("o"))
        down = many - 1 - F.shiftright((F.shiftright("th", 48) + (1 << 15)) * many, 16)
        number = F.when(many.isNotNull(), (2 * between - 1) * stride + down).otherwise(number)
    return number.cast("long"), stride


def with_next(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """doc_id, text, found, cells and ``next``, a struct of the last three of the next row in descending doc_id.

    The first row follows the last. Null ids come last; rows of one doc_id are ordered by a hash of their texts. The
    texts move once, into buckets of neighbouring rows; the first row of each bucket is taken from there for the one
    before.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.xxhash64("text").alias("th"))
    bucket, stride = _bucket(keyed.select("o", "th"))
    dealt = keyed.withColumn("bucket", bucket).repartition("bucket")
    order = W.partitionBy("bucket").orderBy(F.desc("o"), F.asc("th"), F.asc("text"))
    heads = dealt.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    heads = heads.select(F.col("bucket").alias("following"), F.struct("doc_id", "text").alias("head"))
    # which bucket follows which: inside a quotient, then from quotient to quotient (2 * QUANTILES rows at most), then round
    there = keyed.select(bucket.alias("bucket")).distinct().withColumn("quotient", F.floor(F.col("bucket") / stride))
    inside = there.withColumn("following", F.lead("bucket").over(W.partitionBy("quotient").orderBy(F.desc("bucket"))))
    line = W.orderBy(F.desc("quotient"))
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    across = there.groupBy("quotient").agg(F.max("bucket").alias("top"))
    across = across.select("quotient", F.coalesce(F.lead("top").over(line), F.first("top").over(whole)).alias("after"))
    follows = inside.join(across, "quotient").select("bucket", F.coalesce("following", "after").alias("following"))
    edge = follows.join(heads, "following").select("bucket", F.col("head.text").alias("text"))
    edge = sketched(edge, piece).select("bucket", F.struct("text", "found", "cells").alias("edge"))
    rows = sketched(dealt, piece).withColumn("next", F.lead(F.struct("text", "found", "cells")).over(order))
    return rows.join(edge, "bucket").withColumn("next", F.coalesce("next", "edge")).drop("edge", "o", "th", "bucket")


def sketched(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    return rows.withColumn("found", F.expr(digests("text", piece))).withColumn("cells", F.expr(sketch("found")))


def fingerprints(docs: DataFrame, piece: int = PIECE, digests_of_edits: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text of a document has its last floor(n_chars / 2) code points replaced by the first as many, or all,
    of the next document in descending doc_id; after the last comes the first, and a single document follows itself.
    With digests_of_edits, ``removed`` and ``added`` are the paragraph digests that the edit took out and brought in, as
    peeling recovers them. Null texts are empty and have no paragraph. Rows of one doc_id, null included, are documents
    of their own, null ids last. An empty table gives no rows; other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, piece)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = "CAST(n_chars div 2 AS INT)"
    rows = rows.withColumn("edited", F.expr(f"concat(left(text, CAST(n_chars - {half} AS INT)), left(next.text, {half}))"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "found", "cells",
        F.expr(digests("edited", piece)).alias("edited_found"), F.col("next.found").alias("next_found"), F.col("next.cells").alias("next_cells"),
    )
    rows = rows.select("*", F.expr(sketch("edited_found")).alias("edited_cells"))
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", "found", "edited_found", "next_found",
        F.expr(written("cells")).alias("fingerprint"), F.expr(written("edited_cells")).alias("edited_fingerprint"),
        F.expr(compared("found", "edited_found", "cells", "edited_cells")).alias("d_edited"),
        F.expr(compared("found", "next_found", "cells", "next_cells")).alias("d_next"),
    )
    of = lambda name, c: F.expr(f"transform(filter(d_edited, x -> (x & 1) = {c}), x -> shiftright(x, 1))").alias(name)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.expr(likeness("found", "edited_found", "d_edited")).alias("near_edited"),
        F.expr(likeness("found", "next_found", "d_next")).alias("near_next"),
        *([of("removed", 1), of("added", 0)] if digests_of_edits else []),
    )


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
