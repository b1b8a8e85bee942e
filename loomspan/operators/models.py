"""Profile models made ready for alignment: emissions with pseudocounts, backgrounds, transitions by position.

``columns`` are rows of ``text_profiles.model_columns``: name, pos from 0 to length + 1, emissions and transitions in
milli-bits, neffs. Work on a position needs that position alone, but for the averages of a model, which are one grouping.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.vectors import times_matrix
from loomspan.operators import profile, sweeps

# Transitions in a file's order, which is that of programs, too.
MOVES = ["mm", "mi", "md", "im", "ii", "dm", "dd"]


@dataclass(frozen=True)
class Pseudocounts:
    """Mixture of emissions with their substitution expectation: mode, and its three numbers (see ``profile.admixture``)."""

    mode: int = 2
    a: float = 1.0
    b: float = 1.5
    c: float = 1.0


def prepared(columns: DataFrame, matrix: list[list[float]], mixture: Pseudocounts | None = None, tags: DataFrame | None = None) -> DataFrame:
    """name, pos, length, p, pav, neff, transitions: positions 0 to length + 1.

    ``p`` are emissions mixed by ``matrix`` [residue, residue], and the model's average ``pav`` at both ends; ``neff`` is the
    mean effective number of matches; ``transitions`` are log2 with pseudocounts, in the order of MOVES, up to position
    length. ``tags`` (name, first, last) are ranges whose columns become background. Rows with a parse_error are left out,
    and so is a model that has one."""
    mixture = mixture or Pseudocounts()
    broken = columns.where("parse_error IS NOT NULL").select("name").distinct()
    rows = columns.join(broken, "name", "left_anti")
    inner = F.col("pos").between(1, F.col("length"))
    null = rows.where("pos = 0").select("name", F.transform("emissions", profile.emission).alias("pb"))
    f = F.transform("emissions", profile.emission)
    match = F.get("neffs", F.lit(0))
    rows = rows.select("*", f.alias("f")).join(null, "name")
    if tags is not None:
        ranges = tags.groupBy("name").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
        rows = rows.join(ranges, "name", "left")
        hit = inner & F.coalesce(F.exists("ranges", lambda z: F.col("pos").between(z["first"], z["last"])), F.lit(False))
        rows = rows.withColumn("f", F.when(hit, F.col("pb")).otherwise(F.col("f"))).drop("ranges")
    turned = [list(z) for z in zip(*matrix, strict=True)]
    tau = profile.admixture(mixture.mode, match, mixture.a, mixture.b, mixture.c)
    rows = rows.withColumn("p", profile.admixed(F.col("f"), times_matrix(F.col("f"), turned), tau))
    whole = rows.where(inner).groupBy("name").agg(profile.mean_neff(match).alias("neff"))
    rows = rows.join(whole, "name")
    average = profile.background(rows.where(inner), "name", "p", 20, F.col("pb"), F.col("neff"))
    rows = rows.join(average, "name").withColumn("p", F.when(inner, F.col("p")).otherwise(F.col("pav")))
    log2p = {k: -F.get("transitions", F.lit(i)) / 1000 for i, k in enumerate(MOVES)}
    neff = {k: F.get("neffs", F.lit(i)) for i, k in enumerate("mid")}
    moves = profile.gap_transitions(neff, log2p, F.col("pos") == 0, F.col("pos") == F.col("length"))
    return rows.select("name", "pos", "length", "p", "pav", "neff", F.when(F.col("pos") <= F.col("length"), F.array(*[moves[k] for k in MOVES])).alias("transitions"))


def linear(models: DataFrame, beta: float = 1.0) -> DataFrame:
    """``prepared`` models with their transitions as probabilities."""
    return models.withColumn("transitions", F.transform("transitions", lambda x: profile.linear_transition(x, beta)))


def over_null(pairs: DataFrame, models: DataFrame, null: list[float], mode: int = 1) -> DataFrame:
    """pair_id, pos, s: the template's columns over the null model of each pair (``profile.null_model``)."""
    average = models.where("pos = 0").select("name", "pav")
    sides = pairs.join(average.select(F.col("name").alias("query"), F.col("pav").alias("q_pav")), "query").join(average.select(F.col("name").alias("template"), F.col("pav").alias("t_pav")), "template")
    by = profile.null_model(mode, F.array(*map(F.lit, map(float, null))), F.col("q_pav"), F.col("t_pav"))
    return sides.select("pair_id", F.col("template").alias("name"), by.alias("by")).join(models.select("name", "pos", "p"), "name").select("pair_id", "pos", profile.against_background(F.col("p"), F.col("by")).alias("s"))


def _listed(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows of each key as arrays by pos."""
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *[v.alias(c) for c, v in values.items()]))).alias("z"))
    return whole.select(*keys, *[F.col(f"z.{c}").alias(c) for c in values])


def aligned(pairs: DataFrame, models: DataFrame, null: list[float], mode: int = 1) -> DataFrame:
    """pair_id, score, total, posterior, gain, path, accurate: ``pairs`` (pair_id, query, template) of ``prepared`` models.

    Scores are log2 of the products of the query's columns and the template's over the null model; transitions are those of
    each position. Paths are state:x:y by step. A pair is one row, with both models' columns."""
    inner = F.col("pos").between(1, F.col("length"))
    moves = _listed(models.where("transitions IS NOT NULL"), ["name"], {"moves": F.col("transitions")})
    own = _listed(models.where(inner), ["name"], {"p": F.col("p")})
    length = models.where("pos = 0").select(F.col("name").alias("template"), F.col("length"))
    over = over_null(pairs, models, null, mode).join(pairs.select("pair_id", "template"), "pair_id").join(length, "template").where(inner)
    rows = pairs.join(own.select(F.col("name").alias("query"), "p"), "query").join(_listed(over, ["pair_id"], {"s": F.col("s")}), "pair_id")
    for side, c in (("query", "q"), ("template", "t")):
        rows = rows.join(moves.select(F.col("name").alias(side), F.col("moves").alias(c)), side)

    def some(p, s, q, t):
        whole = [[np.stack([np.asarray(r, float) for r in z]) for z in side] for side in (p, s, q, t)]
        text = lambda path: " ".join(f"{k}:{x}:{y}" for k, x, y in path)
        return [{"score": z.score, "total": z.total, "posterior": z.posterior, "gain": z.gain, "path": text(z.path), "accurate": text(z.accurate)} for z in sweeps.align_models(*whole)]

    schema = "score double, total double, posterior double, gain double, path string, accurate string"
    return sweeps.in_batches(rows, some, ["p", "s", "q", "t"], (F.size("p"), F.size("s")), schema)
