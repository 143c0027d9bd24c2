"""Vectors as arrays of doubles, with higher-order functions so that they stay within the JVM. A null vector gives null; of
two vectors of different length the longer one's rest counts with null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of them is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def projection(p: Column, n: Column, eps: float = 1e-8) -> Column:
    """How far p reaches along n."""
    return dot(p, n) / (dot(n, n) + F.lit(eps))


def lerp(a: Column, b: Column, at: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - at) + y * at)


def linear_head(v: Column, weights: list[float], bias: float) -> Column:
    return dot(v, F.array(*map(F.lit, weights))) + F.lit(bias)


def padded(v: Column, n: int, by: float = 0.0) -> Column:
    """Cut or filled to n entries."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(by), n)), 1, n)


def mask_of(v: Column, n: int) -> Column:
    """1 for the entries ``padded`` keeps, 0 for those it adds."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i <= F.size(v)).cast("int"))


def pooled(v: Column, how: str) -> Column:
    """The last, the mean, or the first entry (where a special token stands)."""
    return {"last": F.try_element_at(v, F.lit(-1)), "mean": F.try_divide(total(v), F.size(v))}.get(how, F.get(v, F.lit(0)))


def saturated(v: Column, factor: float) -> Column:
    """Distances from the mean scaled."""
    m = total(v) / F.size(v)
    return F.transform(v, lambda x: (x - m) * F.lit(factor) + m)


def noised(x: Column, noise: Column, sigma: float) -> Column:
    return F.zip_with(x, noise, lambda a, b: b * F.lit(sigma) + a * F.lit(1 - sigma))


def standardized(v: Column, mean: float, std: float) -> Column:
    return F.transform(v, lambda x: (x - F.lit(mean)) * F.lit(1.0 / std))


def pixels(v: Column) -> Column:
    """Bytes to -1..1."""
    return F.transform(v, lambda x: x / F.lit(127.5) - 1)


def to_bytes(v: Column) -> Column:
    """-1..1 to bytes, clamped."""
    return F.transform(v, lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround((x + 1) * F.lit(127.5)))).cast("int"))


def as_text(v: Column, digits: int = 6) -> Column:
    """Entries with fixed digits, joined by commas."""
    return F.array_join(F.transform(v, lambda x: F.format_string(f"%.{digits}f", x)), ",")
