"""Alignments carried over to other frames of their sequences, and contacts of chains.

A known alignment is given between two contents; each content is mapped to a fuller sequence by identity. Those maps are
affine alignments in batches; chaining them is two equi-joins, and the result a whole alignment of the fuller sequences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import alignment
from loomspan.operators.dynamic import AFFINE, NONE
from loomspan.operators.sweeps import Sweep, in_batches, padded

# Scores of equal and of unlike letters, letters that score 0, gaps.
EQUAL, UNLIKE, NEUTRAL = 10.0, -15.0, "XZ."
OPEN, EXTEND = -11.0, -1.0


def identity(a: list[str], b: list[str]) -> list[list[tuple[int, int]]]:
    """Matches of the whole alignments of strings, with affine gaps that are free at both ends."""
    out: list[list[tuple[int, int]]] = [[] for _ in a]
    full = [k for k in range(len(a)) if a[k] and b[k]]
    if not full:
        return out
    sides = [padded([np.array([ord(c) for c in z[k]]) for k in full], 0.0) for z in (a, b)]
    zero = [np.isin(z, [ord(c) for c in NEUTRAL]) for z in sides]
    lengths = np.array([(len(a[k]), len(b[k])) for k in full])
    lx, ly = lengths[:, :1], lengths[:, 1:]

    def weights(d: int, x0: int, x1: int) -> np.ndarray:
        x = np.arange(x0, x1 + 1)
        y = d - x
        found = np.full((len(AFFINE.arcs), len(full), len(x)), NONE)
        i, j = np.maximum(x - 1, 0), np.maximum(y - 1, 0)
        score = np.where(zero[0][:, i] | zero[1][:, j], 0.0, np.where(sides[0][:, i] == sides[1][:, j], EQUAL, UNLIKE))
        inside = (x <= lx) & (y <= ly)
        found[:3] = np.where(inside & (x > 0) & (y > 0), score, NONE)
        # Gaps in y lie beside its ends where no residue of it, or all, are passed; so do those in x.
        for arcs, end in (((3, 4, 5), (y == 0) | (y == ly)), ((6, 7, 8), (x == 0) | (x == lx))):
            for m in arcs:
                found[m] = np.where(inside, np.where(end, 0.0, EXTEND if m == arcs[0] else OPEN), NONE)
        return found

    _, paths = Sweep(AFFINE, lengths, weights).best("whole", order=(0, 2, 1))
    for k, path in zip(full, paths, strict=True):
        out[k] = [(x, y) for s, x, y in path if s == 0]
    return out


def identity_maps(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, x, y: the matches of ``identity`` of each row's strings, each pair of strings aligned once."""
    strings = pairs.select(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")).distinct().withColumn("pair_id", F.struct("a", "b"))
    kind = "found array<struct<x:int,y:int>>"
    maps = in_batches(strings, lambda p, q: [{"found": [{"x": x, "y": y} for x, y in z]} for z in identity(list(p), list(q))], ["a", "b"], (F.length("a"), F.length("b")), kind, states=3)
    maps = maps.select("pair_id.a", "pair_id.b", "found")
    rows = pairs.select(key, F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))
    return rows.join(maps, ["a", "b"]).select(key, F.explode("found").alias("m")).select(key, "m.x", "m.y")


def carried(pairs: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """The whole alignments of ``full_a`` and ``full_b`` (key, step, x, y) and their gapped strings (key, a, b).

    ``pairs`` has key, a and b, the gapped strings of the known alignment, and full_a, full_b. Matches whose residues aren't
    in both fuller sequences are lost; rows with a null string have no match."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit(""))
    rows = pairs.select(key, "a", "b", *[F.coalesce(c, F.lit("")).alias(c) for c in ("full_a", "full_b")], plain(F.col("a")).alias("inner_a"), plain(F.col("b")).alias("inner_b"))
    first, last = identity_maps(rows, key, "full_a", "inner_a"), identity_maps(rows, key, "inner_b", "full_b")
    known = alignment.matches(alignment.from_gapped(rows.where("a IS NOT NULL AND b IS NOT NULL"), key, "a", "b"))
    found = alignment.composed(alignment.composed(first, known, key), last, key)
    lengths = rows.select(key, F.length("full_a").alias("lx"), F.length("full_b").alias("ly"))
    steps = alignment.canonical(lengths, found, key)
    texts = rows.select(key, F.col("full_a").alias("a"), F.col("full_b").alias("b"))
    return steps, alignment.gapped(steps.join(texts, key), key, "a", "b")


def contacts(points: DataFrame, key: str, place: str, at: str, radius: float) -> DataFrame:
    """key, i, j, distance: pairs of a key's points, i before j, that are nearer than ``radius`` but not in one place.

    Points fall into cubes of the radius' size; each is dealt to its own and the 26 around, and meets those of that cube by
    an equi-join: work grows with the points and their neighbours. Points without coordinates have none."""
    rows = points.where(F.col(at).isNotNull()).select(key, F.col(place).alias("i"), F.col(at).alias("p"))
    cube = lambda k, off: (F.floor(F.get("p", F.lit(k)) / radius) + off).cast("long")
    here = rows.select(key, F.col("i").alias("j"), F.col("p").alias("q"), *[cube(k, 0).alias(f"c{k}") for k in range(3)])
    around = F.explode(F.array(*[F.struct(*[cube(k, o).alias(f"c{k}") for k, o in enumerate((a, b, c))]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    met = rows.select(key, "i", "p", around.alias("c")).select(key, "i", "p", "c.*").join(here, [key, "c0", "c1", "c2"]).where("i < j")
    away = F.sqrt(F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))
    return met.select(key, "i", "j", away.alias("distance")).where((F.col("distance") > 0) & (F.col("distance") < radius))
