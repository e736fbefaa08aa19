"""Column functions over vectors. Arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors, vectors of unlike length and nulls."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """Zero vectors stay."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def rounded(x: Column, places: int = 6) -> Column:
    """Half away from zero, in binary and with the sign of a zero, as SQL engines round doubles (Spark's round() has no negative zero)."""
    scale = float(10**places)
    return F.round(F.abs(x) * scale) / scale * F.signum(x)


def quantised(a: Column, scale: int = 10_000) -> Column:
    return F.transform(doubles(a), lambda x: (x * scale).cast("bigint"))


def dequantised(a: Column, scale: int = 10_000, over: int = 1000) -> Column:
    """Scaled back only if a component is larger than `over`."""
    return F.when(F.array_max(F.transform(a, lambda x: F.abs(x))) > over, F.transform(a, lambda x: x / scale)).otherwise(F.transform(a, lambda x: x.cast("double")))


def is_zero(a: Column) -> Column:
    return F.forall(doubles(a), lambda x: x == 0)


def parsed(x: Column) -> Column:
    """From '[1, 2]'."""
    return F.from_json(x, "array<double>")


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors (array of arrays) whose mask is 1; zeros where none is. Null vectors or a null mask give null."""
    v, m = vectors.cast("array<array<double>>"), mask.cast("array<double>")
    kept = F.zip_with(v, m, lambda x, w: F.transform(x, lambda c: c * w))
    zero = F.transform(F.get(v, F.lit(0)), lambda c: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    n = F.greatest(F.aggregate(m, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)
