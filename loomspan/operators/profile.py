"""Profiles: encoding residues, decoding emissions, smoothing, pseudocounts, backgrounds and effective numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.vectors import dot, times_matrix, total

# The two orders of the 20 amino acids; unknown letters have index 20.
ALPHABETIC = "ACDEFGHIKLMNPQRSTVWY"
MATRIX_ORDER = "ARNDCQEGHILKMFPSTWYV"
UNKNOWN = 20
# Transition pseudocounts (match, insert, delete) and their weight; emission pseudocount weight.
TRANSITION_PRIORS = {"mm": 0.6, "mi": 0.2, "md": 0.2, "ii": 0.75, "im": 0.25, "dd": 0.75, "dm": 0.25}
TRANSITION_WEIGHT = 0.1
EMISSION_WEIGHT = 10.0
# Gap parameters of transition pseudocounts, and the prior share of a gap.
RARE_GAP = 0.0286
GAP = {"d": 0.15, "e": 1.0, "f": 0.6, "g": 0.6, "h": 0.6, "i": 0.6, "b": 1.0}
# Affinity tags that are neutralised, and how far a run of H reaches.
TAGS = ["EQKLISEEDL", "DYKDDDDK"]


def residues(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """key, pos (from 1), aa, aa_idx: one row for each letter."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(MATRIX_ORDER) for x in (c, i)])
    letters = df.select(key, F.posexplode(F.split(F.upper(sequence), "")).alias("pos", "aa")).where("aa <> ''")
    return letters.select(key, (F.col("pos") + 1).alias("pos"), "aa", F.coalesce(F.try_element_at(order, F.col("aa")), F.lit(UNKNOWN)).alias("aa_idx"))


def emission(value: Column) -> Column:
    """Probability from milli-bits; null is none."""
    return F.coalesce(F.pow(F.lit(2.0), -value / 1000), F.lit(0.0))


def transition(value: Column, neff: Column, prior: str) -> Column:
    """Transition probability from milli-bits with its pseudocount."""
    p = F.coalesce(F.exp(-value / 1000 * 0.6931), F.lit(0.0))
    return (neff * p + TRANSITION_WEIGHT * TRANSITION_PRIORS[prior]) / (TRANSITION_WEIGHT + neff)


def smoothed(p: Column, neff: Column, matrix: list[list[float]], null: list[float], weight: float = EMISSION_WEIGHT) -> Column:
    """p mixed with its substitution expectation g_j = sum_k p_k G_kj 2^(-null_j)."""
    scaled = [[g * 2.0 ** -null[j] for j, g in enumerate(row)] for row in matrix]
    return F.zip_with(p, times_matrix(p, scaled), lambda x, g: ((neff - 1) * x + weight * g) / (neff - 1 + weight))


def admixture(mode: int, neff: Column, a: float = 1.0, b: float = 1.5, c: float = 1.0) -> Column:
    """Weight tau of pseudocounts by mode: 0 none, 1 constant, 2 divergence, 3 diversity of blocks."""
    if mode == 0:
        return F.lit(0.0)
    if mode == 1:
        return F.lit(a)
    if mode == 2:
        return F.least(F.lit(1.0), F.lit(a) / (1 + F.pow(neff / b, F.lit(c))))
    x = neff / b
    return F.greatest(F.lit(0.0), F.lit(0.793 + 0.048 * (b - 10.0)) * (1 - x + c * x * (1 - x)))


def admixed(f: Column, g: Column, tau: Column) -> Column:
    return F.zip_with(f, g, lambda x, y: (1 - tau) * x + tau * y)


def gap_transitions(neff: dict[str, Column], log2p: dict[str, Column], first: Column, last: Column, gap: dict[str, float] = GAP) -> dict[str, Column]:
    """log2 transitions with pseudocounts: counts by effective numbers (match, insert, delete), gap openings and extensions
    scaled in log space; before the first and after the last column only a match follows."""
    off = gap["d"] * RARE_GAP
    stay = gap["e"] / (gap["e"] - 1 + 1 / 0.75)
    prior = {"mm": 1 - 2 * off, "md": off, "mi": off, "im": 1 - stay, "ii": stay, "dm": 1 - stay, "dd": stay}
    scale = {"md": gap["f"], "mi": gap["g"], "dd": gap["h"], "ii": gap["i"]}
    out: dict[str, Column] = {}
    for part in "mid":
        names = [k for k in prior if k[0] == part]
        seen = neff[part] - 1 if part == "m" else neff[part]
        count = {k: seen * F.coalesce(F.pow(F.lit(2.0), log2p[k]), F.lit(0.0)) + gap["b"] * prior[k] for k in names}
        for k in ("md", "mi"):
            if k in count:
                count[k] = F.when(first | last, 0.0).otherwise(count[k])
        if "dd" in count:
            count["dd"] = F.when(last, 0.0).otherwise(count["dd"])
        whole = sum(count.values(), F.lit(0.0))
        for k in names:
            p = count[k] / whole
            out[k] = F.when(p > 0, F.log2(p)).otherwise(-100000.0) * scale.get(k, 1.0)
    return out


def background(df: DataFrame, key: str, p: str, size: int, prior: Column, neff: Column, weight: float = 100.0) -> DataFrame:
    """key, pav: mean composition of a profile's columns ``p`` with ``weight`` counts of ``prior``, an array that is the same
    in all rows of a key, over its effective number."""
    sums = df.groupBy(key).agg(*[F.sum(F.get(p, F.lit(i))).alias(f"s{i}") for i in range(size)], F.max(neff).alias("neff"), F.first(prior).alias("prior"))
    raw = F.array(*[weight * F.get("prior", F.lit(i)) / F.col("neff") + F.col(f"s{i}") for i in range(size)])
    return sums.select(key, raw.alias("raw")).select(key, F.transform("raw", lambda x: x / total(F.col("raw"))).alias("pav"))


def null_model(mode: int, pb: Column, q: Column, t: Column) -> Column:
    """Background by mode: 0 fixed, 1 mean of both averages, 2 template's, 3 query's."""
    return {0: pb, 1: F.zip_with(q, t, lambda x, y: (x + y) / 2), 2: t, 3: q}[mode]


def against_background(p: Column, background: Column) -> Column:
    """Each probability over its background; 0 where that has none."""
    return F.zip_with(p, background, lambda x, b: F.when(b > 0, x / b).otherwise(0.0))


def effective_number(df: DataFrame, key: str, p: str) -> DataFrame:
    """key, neff: 2 to the mean column entropy."""
    entropy = total(F.transform(p, lambda x: F.when(x > 1e-10, -x * F.log2(x)).otherwise(0.0)))
    return df.groupBy(key).agg(F.pow(F.lit(2.0), F.sum(entropy) / F.count("*")).alias("neff"))


def mean_neff(neff: Column) -> Column:
    return F.avg(F.when(neff == 0, 1.0).otherwise(neff))


def linear_transition(log2p: Column, beta: float = 1.0) -> Column:
    return F.pow(F.lit(2.0), log2p * beta)


def masked(vec: Column, missing: Column) -> Column:
    """Zeros where a position is missing, unknown or disordered."""
    return F.when(missing, F.transform(vec, lambda x: x * 0.0)).otherwise(vec)


def same_state_as_before(ss: str, key: str, pos: str, loop: int | str = 2) -> Column:
    w = Window.partitionBy(key).orderBy(pos)
    return F.coalesce((F.lag(ss).over(w) == F.col(ss)) & (F.col(ss) != loop), F.lit(False))


def his_tags(sequence: Column) -> Column:
    """Starts (from 1) of the first run of three H within ten of the head and of the last one within ten of the tail; an
    empty array without one. A sequence so short that both are the same run has it once."""
    head = F.instr(F.left(sequence, F.lit(12)), "HHH")
    tail = F.instr(F.left(F.reverse(sequence), F.lit(12)), "HHH")
    starts = F.array(head, F.when(tail > 0, F.length(sequence) - tail - 1).otherwise(0))
    return F.array_distinct(F.filter(starts, lambda x: x > 0))


def neutral_ranges(sequence: Column) -> Column:
    """Arrays (first, last) of positions whose columns become background: tags, and a run of five H or more, however long,
    with eight around."""
    runs = F.transform(F.array(*[F.instr(sequence, t) for t in TAGS]), lambda x, i: F.array(x, x + F.get(F.array(*[F.lit(len(t) - 1) for t in TAGS]), i)))
    h, run = F.instr(sequence, "HHHHH"), F.length(F.regexp_extract(sequence, "HHHHH+", 0))
    his = F.array(F.greatest(F.lit(1), h - 8), F.least(F.length(sequence), h + run - 1 + 8))
    return F.concat(F.filter(runs, lambda r: r[0] > 0), F.when(h > 0, F.array(his)).otherwise(F.array().cast("array<array<int>>")))


def gated(features: Column, gates: list[list[float]], outputs: list[float], scale: float) -> Column:
    """A potential: the weighted sum of sigmoid gates over a feature vector."""
    from loomspan.functions.scalar import sigmoid

    out = F.lit(0.0)
    for weights, w in zip(gates, outputs, strict=True):
        out = out + F.lit(float(w)) * sigmoid(F.lit(scale) * dot(features, F.array(*map(F.lit, map(float, weights)))))
    return out
