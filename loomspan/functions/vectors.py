"""Array expressions of profile columns. All are native Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def normalised(a: Column, to: float = 1.0, default: Column | None = None) -> Column:
    """``a`` scaled to the sum ``to``; ``default`` (or ``a``) where its sum is 0."""
    s = total(a)
    return F.when(s != 0, F.transform(a, lambda x: x * F.lit(to) / s)).otherwise(a if default is None else default)


def squared_profile(a: Column) -> Column:
    """A distribution from any vector: each component's share of the squared length."""
    return normalised(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def one_hot(k: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == k, 1.0).otherwise(0.0))


def argmax3(a: Column, b: Column, c: Column) -> Column:
    """Index of the strictly largest of three; ties fall to the last."""
    return F.when((a > b) & (a > c), 0).when((b > a) & (b > c), 1).otherwise(2)


def confident(a: Column, low: float = 0.01, high: float = 0.95) -> Column:
    """Components up to ``low`` become 0; the first of at least ``high``, if any, makes the vector one-hot."""
    at = F.array_position(F.transform(a, lambda x: x >= high), True)
    return F.when(at > 0, F.transform(a, lambda _, i: F.when(i + 1 == at, 1.0).otherwise(0.0))).otherwise(
        F.transform(a, lambda x: F.when(x <= low, 0.0).otherwise(x))
    )


def repaired(a: Column, own: Column, low: float = 0.9, high: float = 1.1) -> Column:
    """A row whose sum is out of bounds becomes one-hot on its own residue (0-based)."""
    s = total(a)
    return F.when((s < low) | (s > high), F.transform(a, lambda _, i: F.when(i == own, 1.0).otherwise(0.0))).otherwise(a)


def times_matrix(a: Column, rows: list[list[float]]) -> Column:
    """The vector-matrix product with a literal matrix."""
    return F.array(*[dot(a, F.array(*[F.lit(float(r[j])) for r in rows])) for j in range(len(rows[0]))])


def distance(a: Column, b: Column, missing: float = 8.0) -> Column:
    """Euclidean; ``missing`` where either point is null."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    return F.when(a.isNull() | b.isNull(), F.lit(missing)).otherwise(d)
