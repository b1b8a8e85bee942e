"""Positions of templates and targets, as ``potentials`` takes them, from the tables that the readers of profile files give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.vectors import argmax3, confident, one_hot, repaired
from loomspan.operators.profile import ALPHABETIC, MATRIX_ORDER, UNKNOWN, emission, masked, smoothed
from loomspan.sources.text_profiles import STATES

# The class vector of three states has loop, helix and strand in this order; state numbers are 0 helix,
# 1 strand, 2 loop. A target position is masked if its disorder is larger than this.
CLASS_PLACE = {"H": 1, "E": 2}
STATE_NUMBER = {"H": 0, "E": 1}
DISORDER = 0.2


def _index(letters: str, aa: Column, none: int | None) -> Column:
    at = F.instr(F.lit(letters), aa)
    return F.when((aa != "") & (at > 0), (at - 1).cast("int")).otherwise(F.lit(none).cast("int"))


def emitted(columns: DataFrame, matrix: list[list[float]], null: list[float]) -> DataFrame:
    """profile_id, pos, aa_idx, own, raw, p, s: of profile columns, decoded, repaired and smoothed by a 20 x 20 matrix.

    A row whose sum is out of bounds becomes its own residue; if that is unknown, it is all 0."""
    raw = repaired(F.transform("emissions", emission), F.col("own"))
    rows = columns.where("parse_error IS NULL").select("profile_id", "pos", "neffs", "emissions", _index(MATRIX_ORDER, F.col("aa"), UNKNOWN).alias("aa_idx"), _index(ALPHABETIC, F.col("aa"), None).alias("own"))
    rows = rows.withColumn("raw", F.transform(raw, lambda x: F.coalesce(x, F.lit(0.0))))
    rows = rows.withColumn("p", smoothed(F.col("raw"), F.coalesce(F.get("neffs", F.lit(0)), F.lit(0.0)), matrix, null))
    return rows.select("profile_id", "pos", "aa_idx", "own", "raw", "p", F.transform("p", lambda x: F.when(x > 0, F.log2(x)).otherwise(-100000.0)).alias("s"))


def template_positions(features: DataFrame, columns: DataFrame, matrix: list[list[float]], null: list[float]) -> DataFrame:
    """Known classes as one-hot vectors, all 0 where a residue is missing or unknown; with is_missing and ca."""

    def by_state(places: dict[str, int], other: int) -> Column:
        out = F.when(F.lit(False), other)
        for letter, k in places.items():
            out = out.when(F.col("ss8_letter") == letter, k)
        return out.otherwise(other)

    rows = features.where("parse_error IS NULL").select("profile_id", "pos", "is_missing", F.col("ss8").alias("ss8_letter"), "acc_class", "ca").join(emitted(columns, matrix, null), ["profile_id", "pos"])
    off = F.col("is_missing") | (F.col("aa_idx") == UNKNOWN)
    classes = {"ss3": (by_state(CLASS_PLACE, 0), 3), "ss8": (_index(STATES, F.col("ss8_letter"), None), 8), "acc": (F.col("acc_class"), 3)}
    return rows.select("*", by_state(STATE_NUMBER, 2).alias("ss"), *[masked(one_hot(k, n), off).alias(c) for c, (k, n) in classes.items()]).drop("ss8_letter")


def target_positions(features: DataFrame, columns: DataFrame, disorder: DataFrame, matrix: list[list[float]], null: list[float], threshold: float = DISORDER) -> DataFrame:
    """Predicted classes, all 0 where disorder exceeds ``threshold``; a position without disorder has none."""
    # Classes are found below the joins, masked above them: Spark shares what one projection has twice, and gets the lambdas
    # of ``confident`` wrong where one use of them is behind a condition.
    access = confident(F.col("acc"))
    state, open_ = (argmax3(*[F.get(c, F.lit(i)) for i in range(3)]).cast("int") for c in (F.col("ss3"), access))
    found = features.where("parse_error IS NULL").select("profile_id", "pos", "ss3", "ss8", access.alias("access"), state.alias("ss"), open_.alias("acc_class"))
    rows = found.join(emitted(columns, matrix, null), ["profile_id", "pos"]).join(disorder, ["profile_id", "pos"], "left")
    off = F.coalesce(F.col("disorder") > threshold, F.lit(False))
    own = F.col("aa_idx"), F.col("own"), F.col("raw"), F.col("p"), F.col("s")
    return rows.select("profile_id", "pos", *own, "ss", masked(F.col("ss3"), off).alias("ss3"), masked(F.col("ss8"), off).alias("ss8"), masked(F.col("access"), off).alias("acc"), "acc_class")
