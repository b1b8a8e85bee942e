"""Similarities of two profile columns. p, q are distributions, s, t log2 scores, n background offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.vectors import dot, total

# Similarity by the absolute difference of two three-class accessibilities.
ACCESS_BY_DIFFERENCE = [3, 1, -2]


def log_odds(p: Column, q: Column, n: Column, times: int = 1, none: float = -10.0) -> Column:
    """ln of the sum of p q 2^(times n); ``none`` where the sum isn't positive."""
    m = dot(F.zip_with(p, q, lambda x, y: x * y), F.transform(n, lambda v: F.pow(F.lit(2.0), v * times)))
    return F.when(m > 0, F.ln(m)).otherwise(none)


def entropy_similarity(p: Column, q: Column, size: int) -> Column:
    """One minus the entropy of the mean distribution, as a share of the largest."""
    mean = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (total(F.transform(mean, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))) + math.log(size)) / math.log(size)


def bidirectional(p: Column, s: Column, q: Column, t: Column, n: Column) -> Column:
    return dot(p, F.zip_with(t, n, lambda x, y: x + y)) + dot(q, F.zip_with(s, n, lambda x, y: x + y))


def score_at(s: Column, n: Column, index: Column) -> Column:
    """The offset score of one residue; 0 for an unknown one."""
    return F.coalesce(F.get(s, index) + F.get(n, index), F.lit(0.0))


def access_similarity(a: Column, b: Column) -> Column:
    return F.get(F.array(*map(F.lit, ACCESS_BY_DIFFERENCE)), F.abs(a - b))


def class_equal(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def bilinear(a: Column, b: Column, matrix: list[list[float]]) -> Column:
    """a' M b; with ``a`` one-hot, a row of the matrix times b."""
    return dot(F.array(*[dot(b, F.array(*map(F.lit, map(float, row)))) for row in matrix]), a)


def column_score(p: Column, q: Column) -> Column:
    """log2 of the dot product of two columns."""
    d = dot(p, q)
    return F.when(d > 0, F.log2(d)).otherwise(-100000.0)
