"""Scalar expressions: significance of scores, log-space sums, numbers in text, paths, keyed random numbers."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (a, b, c, d) of the probability of a true positive, for local and global alignment.
TRUE_POSITIVE = {"local": (math.sqrt(4000), 5.0, math.sqrt(0.15), 68.0), "global": (math.sqrt(6000), 5.0, math.sqrt(0.1), 74.0)}


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def p_value(score: Column, lam: Column, mu: Column) -> Column:
    """Tail of the extreme-value distribution."""
    h = lam * (score - mu)
    return F.when(h > 10, F.exp(-h)).otherwise(1 - F.exp(-F.exp(-h)))


def log_p_value(score: Column, lam: Column, mu: Column) -> Column:
    h = lam * (score - mu)
    return F.when(h > 10, -h).when(h < -2.5, -F.exp(-F.exp(-h))).otherwise(F.ln(1 - F.exp(-F.exp(-h))))


def true_positive(score: Column, kind: str = "local") -> Column:
    """Probability in percent that a hit is true."""
    a, b, c, d = TRUE_POSITIVE[kind]
    t = F.lit(a) * F.exp(-score / b) + F.lit(c) * F.exp(-score / d)
    return F.when(score > 200, 100.0).otherwise(100 / (1 + t * t))


def log_sum_exp(x: Column, most: Column) -> Column:
    """Aggregate: ln of the sum of e^x, given the group's largest value."""
    return F.first(most) + F.ln(F.sum(F.exp(x - most)))


def safe_log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).otherwise(-100000.0)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def first_int(s: Column) -> Column:
    """The first integer in a text; null without one."""
    return F.expr("1") * F.regexp_extract(s, r"-?\d+", 0).try_cast("bigint")


def first_float(s: Column, star: float = 99999.0) -> Column:
    """The first number in a text, ``star`` for a ``*`` before any number."""
    found = F.regexp_extract(s, r"\*|-?\d+(?:\.\d+)?", 0)
    return F.when(found == "*", star).otherwise(found.try_cast("double"))


def first_word(s: Column) -> Column:
    return F.regexp_extract(s, r"\S+", 0)


def cut_at(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, 1)


def between(s: Column, first: int, last: int) -> Column:
    """Characters ``first`` to ``last``, both counted from 0 and taken."""
    return F.substring(s, first + 1, last - first + 1)


def from_mark(s: Column, mark: str) -> Column:
    """What begins at a mark's first occurrence; null without one."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.substring(s, at, F.length(s)))


def transliterated(s: Column, letters: str, by: str) -> Column:
    return F.translate(s, letters, by)


def without_range(s: Column, low: str, high: str) -> Column:
    """Without the characters from ``low`` to ``high``."""
    return F.array_join(F.filter(F.split(s, ""), lambda c: ~c.between(low, high)), "")


def count_range(s: Column, low: str, high: str) -> Column:
    return F.size(F.filter(F.split(s, ""), lambda c: c.between(low, high)))


def replaced_first(s: Column, old: str, new: str) -> Column:
    """With a text's first occurrence replaced; what follows it stays."""
    at = F.instr(s, old)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), F.substring(s, at + len(old), F.length(s)))).otherwise(s)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def _fitted(x: float, width: int) -> str:
    size, minus = math.log10(abs(x)) if x else -math.inf, int(x < 0)
    if math.isnan(x) or size >= width - minus - 1 or size < -3:
        return f"%{width}.{max(width - 6 - minus, 1)}e" % x
    return f"%#{width}.{width - 2 - minus - max(math.floor(size), 0)}f" % x


def fitted(x: Column, width: int) -> Column:
    """A number with as many digits as ``width`` characters hold: in exponential form where its size needs that, else with a
    decimal point. At least one digit follows the point of an exponential form, which may exceed the width.

    Digits are those of the number's exact value, as C rounds it; Java's formatter rounds its shortest decimal form."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _fitted(v, width) for v in values.to_pylist()], pa.string())

    return text(x.cast("double"))


def trimmed(s: Column, start: int, length: int) -> Column:
    """``length`` characters from ``start`` (from 0) on; the whole text for a negative start, all that is left where the
    length isn't positive or too large."""
    at, size = F.lit(max(start, 0)), F.length(s)
    rest = size - at
    count = rest if length <= 0 else F.least(F.lit(length), rest)
    return s if start < 0 else F.substring(s, at + 1, F.greatest(count, F.lit(0)))


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on its keys only, not on partitions."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**53)) + 0.5) / float(2**53)


def keyed_normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.ln(keyed_uniform(seed, *keys))) * F.cos(2 * math.pi * keyed_uniform(seed + 1, *keys))
