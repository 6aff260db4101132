"""Vector functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine."""
    return 1 - cosine(a, b)


def l2_normalize(v: Column) -> Column:
    """The vector scaled to length 1; null for the zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def of_dimension(v: Column, size: int) -> Column:
    """The vector, or null if it has another size or a value that is no finite number."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(v) == size) & finite, v)


def hash_embed(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding provider: counts of hashed words with hashed signs."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    zero = F.array_repeat(F.lit(0.0), size)

    def add(v: Column, w: Column) -> Column:
        h = F.xxhash64(w)
        slot, sign = F.pmod(h, F.lit(size)), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        return F.transform(v, lambda x, i: F.when(i == slot, x + sign).otherwise(x))

    return F.aggregate(words, zero, add)
