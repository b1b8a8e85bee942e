"""Alignment scores of short strings as nested aggregates, without Python. Quadratic copies: for up to about 64 letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def global_score(a: Column, b: Column, match: float, mismatch: float, gap: float) -> Column:
    """Best score of a global alignment with a linear gap cost; ``a`` and ``b`` are strings."""
    return F.element_at(_rows(F.split(a, ""), F.split(b, ""), match, mismatch, gap, local=False), -1)


def local_score(a: Column, b: Column, match: float, mismatch: float, gap: float) -> Column:
    """Best score of any local alignment, at least 0."""
    width = F.size(F.split(b, "")) + 1
    start = F.struct(F.array_repeat(F.lit(0.0), width).alias("row"), F.lit(0.0).alias("best"))
    step = lambda s, c: _local_step(s, c, F.split(b, ""), match, mismatch, gap)
    return F.aggregate(F.split(a, ""), start, step, lambda s: s["best"])


def _rows(a: Column, b: Column, match: float, mismatch: float, gap: float, local: bool) -> Column:
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j * F.lit(float(gap)))

    def step(row: Column, c: Column) -> Column:
        return _next(row, c, b, match, mismatch, gap, row[0] + gap)

    return F.aggregate(F.filter(a, lambda c: c != ""), first, step)


def _next(row: Column, c: Column, b: Column, match: float, mismatch: float, gap: float, head: Column) -> Column:
    """One row from the one before: each cell from the three before it."""

    def cell(out: Column, j: Column) -> Column:
        across = F.get(row, j - 1) + F.when(F.get(b, j - 1) == c, float(match)).otherwise(float(mismatch))
        return F.concat(out, F.array(F.greatest(across, F.get(row, j) + gap, F.element_at(out, -1) + gap)))

    return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(head), cell)


def _local_step(s: Column, c: Column, b: Column, match: float, mismatch: float, gap: float) -> Column:
    raw = _next(s["row"], c, b, match, mismatch, gap, F.lit(0.0))
    row = F.transform(raw, lambda v: F.greatest(v, F.lit(0.0)))
    return F.struct(row.alias("row"), F.greatest(s["best"], F.array_max(row)).alias("best"))
