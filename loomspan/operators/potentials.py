"""Potentials of the cells of profile pairs: cell features, diagonal windows and gate outputs; ``tiles`` computes them faster.

A table of positions has profile_id, pos (from 1, without holes), aa_idx (0..19 in matrix order, 20 unknown), own (index of
the residue in ``p``, null if unknown), p and s (20 probabilities and log2 scores), raw (20 probabilities before smoothing),
ss (0..2), ss3, ss8 and acc (3, 8 and 3 class weights) and acc_class (0..2). A table of pairs has pair_id, template_id and
target_id. Pairs of which a profile has no position lead to no rows.

Cells are as many as the product of both lengths. They are made by two joins on a profile's id and a salt, so that one
profile in many pairs is spread over tasks, and shuffled once, by diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import similarity
from loomspan.functions.vectors import dot
from loomspan.operators.profile import UNKNOWN

WINDOW = 5
# Similarity of three secondary structure classes.
STRUCTURE = [[3.23, -22.57, -5.28], [-22.57, 4.56, -2.52], [-5.28, -2.52, 4.24]]
# Gates of the transition from match to match and of others; places of transitions in the model; scales.
GATES = {0: 12}
OTHER_GATES = 7
TRANSITIONS, WIDEST, INPUTS = 8, 12, 398
MATCH = {"m0": 0, "m1": 3, "m2": 6}
TEMPLATE_GAPS, TARGET_GAPS = {"mi": 1, "ii": 4}, {"md": 2, "dd": 7, "id": 5}
MATCH_SCALE, GAP_SCALE = 0.001, 0.01


@dataclass(frozen=True)
class Model:
    """``outputs`` [transition, gate] and ``hidden`` [transition, gate, bias and features]."""

    outputs: np.ndarray
    hidden: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Model:
        """From all weights in a row: outputs, then hidden ones."""
        values, n = np.asarray(values, float), TRANSITIONS * WIDEST
        if len(values) != n * (1 + INPUTS):
            raise ValueError(f"{n * (1 + INPUTS)} weights, not {len(values)}")
        return Model(values[:n].reshape(TRANSITIONS, WIDEST), values[n:].reshape(TRANSITIONS, WIDEST, INPUTS))

    def potential(self, m: int, features: np.ndarray, scale: float) -> np.ndarray:
        gates, size = GATES.get(m, OTHER_GATES), features.shape[1]
        w = self.hidden[m, :gates]
        return (1 / (1 + np.exp(-scale * (features @ w[:, 1 : size + 1].T + w[:, 0])))) @ self.outputs[m, :gates]


def _thousands(x: Column) -> Column:
    return (1000 * x).cast("int")


def _products(a: Column, b: Column) -> Column:
    """All products of two class vectors, in thousandths."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: (1000 * x * y).cast("int"))))


def _edges(positions: DataFrame) -> DataFrame:
    """With one empty position before the first and one after the last."""
    ends = positions.groupBy("profile_id").agg(F.max("pos").alias("n")).select("profile_id", F.explode(F.array(F.lit(0), (F.col("n") + 1).cast("int"))).alias("pos"))
    return positions.unionByName(ends, allowMissingColumns=True)


def grid(pairs: DataFrame, templates: DataFrame, targets: DataFrame, salts: int = 16) -> DataFrame:
    """pair_id, x, y, t, u: every cell with the positions of both sides, and the empty cells around them."""
    fields = ["aa_idx", "own", "p", "s", "raw", "ss", "ss3", "ss8", "acc", "acc_class"]

    def side(positions: DataFrame, key: str, pos: str, name: str) -> DataFrame:
        rows = _edges(positions.select("profile_id", F.col("pos").cast("int").alias("pos"), *fields))
        return rows.select(F.col("profile_id").alias(key), F.col("pos").alias(pos), F.struct(*fields).alias(name), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    dealt = pairs.select("pair_id", "template_id", "target_id", F.pmod(F.xxhash64("pair_id"), F.lit(salts)).cast("int").alias("salt"))
    both = dealt.join(side(templates, "template_id", "x", "t"), ["template_id", "salt"]).join(side(targets, "target_id", "y", "u"), ["target_id", "salt"])
    return both.select("pair_id", "x", "y", "t", "u")


def cell_features(pairs: DataFrame, templates: DataFrame, targets: DataFrame, null: list[float], tables: tuple[list[float], list[float]], mode: str = "template", substitution: list[float] | None = None, salts: int = 16) -> DataFrame:
    """pair_id, x, y, features: 396 whole numbers for each cell.

    They are 20 products of the raw probabilities; eight similarities at each of eleven offsets along the diagonal; the two
    values of the residue pair in ``tables`` (400 each, by template residue and target residue); and 26 products of classes
    at each offset. Beyond the grid all are 0, but the sum of the similarity over three cells next to its edge. ``null`` are
    20 offsets in log2. Mode ``target`` has profile similarities and ``substitution`` (400 values) only."""
    n = F.array(*map(F.lit, map(float, null)))
    inside = F.col("t.p").isNotNull() & F.col("u.p").isNotNull()
    tp, up = F.col("t.p"), F.col("u.p")
    pair = F.when((F.col("t.aa_idx") < UNKNOWN) & (F.col("u.aa_idx") < UNKNOWN), F.col("t.aa_idx") * UNKNOWN + F.col("u.aa_idx"))

    def looked_up(values: list[float]) -> Column:
        return F.coalesce(F.get(F.array(*map(F.lit, map(float, values))), pair), F.lit(0.0))

    m2, m3 = similarity.log_odds(up, tp, n), similarity.log_odds(up, tp, n, 2, 0.0)
    m5 = similarity.bidirectional(up, F.col("u.s"), tp, F.col("t.s"), n)
    if mode == "template":
        rows = F.array(*[F.array(*map(F.lit, r)) for r in STRUCTURE])
        own = [
            _thousands(F.col("m2")), _thousands(F.col("m2") * similarity.entropy_similarity(tp, up, 20)), F.lit(0), _thousands(m5), _thousands(m3), 1000 * similarity.class_equal(F.col("t.ss"), F.col("u.ss")),
            _thousands(dot(F.get(rows, F.col("u.ss")), F.col("u.ss3"))), 1000 * similarity.access_similarity(F.col("t.acc_class"), F.col("u.acc_class")),
        ]
        structure = F.concat(_products(F.col("t.ss3"), F.col("u.ss3")), F.zip_with("t.ss8", "u.ss8", lambda x, y: (1000 * x * y).cast("int")), _products(F.col("t.acc"), F.col("u.acc")))
        raw = F.zip_with("t.raw", "u.raw", lambda x, y: (10000 * x * y).cast("int"))
    else:
        at = [_thousands(similarity.score_at(F.col(f"{a}.s"), n, F.col(f"{b}.own"))) for a, b in (("t", "u"), ("u", "t"))]
        own = [_thousands(F.col("m2")), _thousands(m3), _thousands(m5), *at, F.lit(0), _thousands(0.1 * looked_up(substitution or [0.0] * 400)), F.lit(0)]
        structure, raw = F.array_repeat(F.lit(0), 26), F.array_repeat(F.lit(0), 20)

    none = F.array_repeat(F.lit(0), 34)
    cells = grid(pairs, templates, targets, salts).withColumn("m2", F.when(inside, m2).otherwise(0.0)).select(
        "pair_id", "x", "y", (F.col("x") - F.col("y")).alias("diagonal"), "m2", inside.alias("inside"), F.when(inside, F.concat(F.array(*own), structure)).otherwise(none).alias("v"), raw.alias("raw"),
        F.array(*[_thousands(looked_up(values)) for values in tables]).alias("pair"),
    )
    diagonal = Window.partitionBy("pair_id", "diagonal").orderBy("x")
    if mode == "template":
        near = _thousands(F.col("m2") + F.lag("m2", 1, 0.0).over(diagonal) + F.lead("m2", 1, 0.0).over(diagonal))
        cells = cells.withColumn("near", near).withColumn("v", F.transform("v", lambda z, i: F.when(i == 2, F.col("near")).otherwise(z)))
    offsets = range(-WINDOW, WINDOW + 1)
    cells = cells.select("*", *[(F.lead("v", k).over(diagonal) if k > 0 else F.lag("v", -k).over(diagonal)).alias(f"v{k}") for k in offsets if k])
    seen = [F.coalesce(F.col(f"`v{k}`"), none) if k else F.col("v") for k in offsets]
    features = F.concat("raw", *[F.slice(v, 1, 8) for v in seen], "pair", *[F.slice(v, 9, 26) for v in seen])
    return cells.where("inside").select("pair_id", "x", "y", features.alias("features"))


def gap_features(positions: DataFrame, structure: bool = True) -> DataFrame:
    """profile_id, pos, features: 20 raw probabilities and, at each of eleven offsets, 14 class weights, in hundredths."""
    along = Window.partitionBy("profile_id").orderBy("pos")
    rows = positions.select("profile_id", "pos", "raw", F.concat("ss3", "ss8", "acc").alias("v"))
    parts = [F.transform("raw", lambda x: (100 * x).cast("int"))]
    if structure:
        rows = rows.withColumn("v", F.transform("v", lambda x: (100 * x).cast("int")))
        rows = rows.select("*", *[(F.lead("v", k).over(along) if k > 0 else F.lag("v", -k).over(along)).alias(f"v{k}") for k in range(-WINDOW, WINDOW + 1) if k])
        parts += [F.coalesce(F.col(f"`v{k}`"), F.array_repeat(F.lit(0), 14)) if k else F.col("v") for k in range(-WINDOW, WINDOW + 1)]
    return rows.select("profile_id", "pos", F.concat(*parts).alias("features"))


def sparse(features: str, most: int | None = None) -> Column:
    """(d, value) of the bias, at 0, and of all features that aren't zero, from 1; the first ``most`` if given."""
    entries = F.filter(F.transform(features, lambda x, i: F.struct((i + 1).alias("d"), x.alias("value"))), lambda z: z["value"] != 0)
    whole = F.concat(F.array(F.struct(F.lit(0).alias("d"), F.lit(1).alias("value"))), entries)
    return whole if most is None else F.slice(whole, 1, most)


def potentials(df: DataFrame, model: Model, transitions: dict[str, int], scale: float, most: int | None = None) -> DataFrame:
    """The columns but ``features``, and a potential for each transition: the weighted sum of gates over the features.

    A product of matrices for each Arrow batch; the model has a fixed size of some 300 KB. ``most`` keeps the first entries
    that aren't zero, the bias among them, as ``sparse`` does."""
    kept = [c for c in df.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            if most is not None:
                f *= np.cumsum(f != 0, axis=1) < most
            found = [pa.array(model.potential(m, f, scale)) for m in transitions.values()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, names=[*kept, *transitions])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in kept] + [f"{c} double" for c in transitions]))


def gap_potentials(positions: DataFrame, model: Model, side: str) -> DataFrame:
    """profile_id, pos and the potentials of gaps: once for each position, not for each cell."""
    return potentials(gap_features(positions), model, TEMPLATE_GAPS if side == "template" else TARGET_GAPS, GAP_SCALE)
