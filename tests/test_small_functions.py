"""Text helpers, cell masks, division by a background, search in an alignment."""

import numpy as np
from pyspark.sql import functions as F

from loomspan.functions import scalar
from loomspan.operators import alignment, dynamic, profile


def test_text_helpers(spark):
    df = spark.createDataFrame([("a1b2a1c",), ("",), (None,)], "s string")
    s = F.col("s")
    rows = df.select(
        scalar.between(s, 1, 3), scalar.from_mark(s, "b"), scalar.transliterated(s, "ab", "xy"), scalar.without_range(s, "0", "9"), scalar.count_range(s, "0", "9"), scalar.replaced_first(s, "a1", "--")
    ).collect()
    assert tuple(rows[0]) == ("1b2", "b2a1c", "x1y2x1c", "abac", 3, "--b2a1c")
    assert tuple(rows[1]) == ("", None, "", "", 0, "")
    assert all(rows[2][k] is None for k in (0, 1, 2, 3, 5))


def test_masks():
    path = [(0, 3, 3), (0, 4, 4)]
    near = dynamic.beside((6, 6), path, 1)
    assert sorted(map(tuple, np.argwhere(near) + 1)) == [(2, 3), (3, 2), (3, 3), (3, 4), (4, 3), (4, 4), (4, 5), (5, 4)]
    left = dynamic.left_by(np.ones((6, 6), bool), path, 1)
    assert (left == ~near).all()
    way = dynamic.corridor((6, 6), path, 1)
    assert way[:2, :2].all() and way[4:, 4:].all() and not way[0, 5] and not way[5, 0] and way.sum() == near.sum() + 4 + 4
    assert not dynamic.corridor((3, 3), [], 1).any()


def test_masked_pair_stays_in_its_cells():
    rng = np.random.default_rng(3)
    score, tr = rng.normal(size=(6, 7)) + 1, np.log2(np.array([0.9, 0.05, 0.05, 0.3, 0.7, 0.3, 0.7]))
    allowed = np.zeros((6, 7), bool)
    allowed[1:4, 2:5] = True
    phi = dynamic.pair_potentials(score, np.tile(tr, (7, 1)), np.tile(tr, (8, 1)), allowed=allowed)
    _, path = dynamic.local_path(dynamic.PAIR, phi)
    assert path and all(allowed[x - 1, y - 1] for s, x, y in path if s == 0)


def test_background_and_search(spark):
    df = spark.createDataFrame([([0.5, 0.2, 0.3], [0.25, 0.4, 0.0])], "p array<double>, b array<double>")
    assert df.select(profile.against_background(F.col("p"), F.col("b"))).first()[0] == [2.0, 0.5, 0.0]
    steps = spark.createDataFrame([(0, 1, 1), (1, 2, None), (2, 3, 2)], "step int, x int, y int")
    assert [tuple(r) for r in alignment.at_target(steps, 2).collect()] == [(2, 3, 2)] and not alignment.at_target(steps, 9).collect()


def test_numbers_in_a_width(spark):
    """As printf writes them with the digits that fit."""
    values = [0.0, 1.0, -1.0, 12.5, -123.456, 99999.0, 1234567.0, -1234567.0, 0.01234, -0.000012, 9.99, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for width in (5, 8):
        for v, (got,) in zip(values, df.select(scalar.fitted(F.col("x"), width)).collect(), strict=True):
            minus, size = int(v < 0), np.log10(abs(v)) if v else -np.inf
            if size >= width - minus - 1 or -size > 3:
                want = f"%{width}.{max(1, width - 6 - minus)}e" % v
            else:
                want = f"%#{width}.{width - 2 - minus - (int(size) if size > 0 else 0)}f" % v
            assert got == want
    texts = spark.createDataFrame([("abcdef",), ("ab",), (None,)], "s string")
    assert [tuple(r) for r in texts.select(scalar.trimmed(F.col("s"), 1, 3), scalar.trimmed(F.col("s"), 1, 0), scalar.trimmed(F.col("s"), -1, 2), scalar.trimmed(F.col("s"), 4, 9)).collect()] == [("bcd", "bcdef", "abcdef", "ef"), ("b", "b", "ab", ""), (None, None, None, None)]


def test_numbers_halfway_between_two_texts(spark):
    """The exact value decides, as in C; nulls stay, and what isn't finite is written as C does."""
    cases = [(2.5, "3.086419"), (7.5, "9.259258"), (-75.0, "-92.5926"), (2500.0, "3086.419"), (None, None), (float("nan"), "     nan"), (float("inf"), "     inf"), (float("-inf"), "    -inf")]
    df = spark.createDataFrame([(v,) for v, _ in cases], "x double")
    assert [r[0] for r in df.select(scalar.fitted(F.col("x") * 1.2345678, 8)).collect()] == [w for _, w in cases]
