"""Vector measures as Column expressions over ``array<double>``; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def clamped(v: Column) -> Column:
    """Negative components become 0."""
    return F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def clipped(v: Column) -> Column:
    return F.transform(v, lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))


def scaled(v: Column, length: Column) -> Column:
    """v / length; null where the length is 0."""
    # as a variable of a lambda the length is computed once, not for each component
    over = lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(length), over), F.lit(0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of length 1."""
    return dot(a, b)


def sqrt_cosine(a: Column, b: Column) -> Column:
    """The sum of component-wise roots over the product of the sums."""
    over = total(a) * total(b)
    return F.when(over > 0, total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y))) / over)


def p_norm(a: Column, b: Column, p: float = 2.0, scale: float = 0.5) -> Column:
    apart = F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p))
    return F.greatest(F.lit(0.0), 1 - apart * scale)


def nicdm(a: Column, b: Column, mean_a: Column, mean_b: Column) -> Column:
    """Distance scaled by the mean neighbour distances of both sides."""
    return scaled_nearness(distance(a, b), mean_a, mean_b)


def scaled_nearness(apart: Column, mean_a: Column, mean_b: Column) -> Column:
    size = F.sqrt(mean_a * mean_b)
    near = F.when(size > 0, apart / size)
    return 1 - near * near / 2


def apsynp(ranks_a: Column, ranks_b: Column, p: float = 0.1) -> Column:
    """Inverse mean ranks, scaled to 0..1 between the least and the greatest value that so many ranks can give."""
    dims = F.size(ranks_a)
    most = total(F.transform(F.sequence(F.lit(1), dims), lambda i: F.pow(i.cast("double"), F.lit(-p))))
    least = dims * F.pow((1 + dims) / 2, F.lit(-p))
    raw = total(F.zip_with(ranks_a, ranks_b, lambda x, y: 2.0 / (F.pow(x.cast("double"), F.lit(p)) + F.pow(y.cast("double"), F.lit(p)))))
    return (raw - least) / (most - least)


def ranked(value: Column, percentiles: Column) -> Column:
    """Piecewise linear place of the value among ascending percentiles: 0 below the first, 1 above the last."""
    n = F.size(percentiles)
    below = F.size(F.filter(percentiles, lambda x: x <= value))
    low, high = F.get(percentiles, below - 1), F.get(percentiles, below)
    inside = (below - 1 + F.when(high > low, (value - low) / (high - low)).otherwise(0.0)) / (n - 1)
    return F.when(below == 0, 0.0).when(below >= n, 1.0).otherwise(inside)


#: Measures on the columns ``a`` and ``b`` of a pair; further columns as named.
MEASURES = {
    "cosine": lambda: cosine(F.col("a"), F.col("b")),
    "sqrt-cosine": lambda: sqrt_cosine(F.col("a"), F.col("b")),
    "p-norm": lambda: p_norm(F.col("a"), F.col("b")),
    # Other powers and what scales their distances.
    "pnorm-2": lambda: p_norm(F.col("a"), F.col("b"), 2.0, 1 / 2),
    "pnorm-1": lambda: p_norm(F.col("a"), F.col("b"), 1.0, 1.0),
    "pnorm-0.5": lambda: p_norm(F.col("a"), F.col("b"), 0.5, 1 / 5000),
    "pnorm-0.1": lambda: p_norm(F.col("a"), F.col("b"), 0.1, 1 / 1000000000),
    "maximum": lambda: F.greatest(cosine(F.col("a"), F.col("b")), p_norm(F.col("a"), F.col("b"))),
    "nicdm": lambda: nicdm(F.col("a"), F.col("b"), F.col("mean_a"), F.col("mean_b")),
    "apsynp": lambda: apsynp(F.col("ranks_a"), F.col("ranks_b")),
}


def measure(name: str) -> Column:
    if name not in MEASURES:
        raise ValueError(f"unknown similarity measure: {name}")
    return MEASURES[name]()
