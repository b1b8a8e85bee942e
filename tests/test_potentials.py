"""From profile files to alignments: readers, positions, features, weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import chain, positions, potentials, tiles
from loomspan.operators.profile import ALPHABETIC
from loomspan.plans import potential_queries
from loomspan.sources import model_weights, text_profiles

SEQUENCE = "ACDEFGHIKLMNPQRSTVWYAX"
NULL = [2.0] * 20
NONE = ([0.0] * 400, [0.0] * 400)
FLAT = [[0.05] * 20 for _ in range(20)]


def columns(sequence):
    out = ["//////////// Original HHM file", *[f"h{k}" for k in range(5)]]
    for i, aa in enumerate(sequence, 1):
        out += [f"{aa} {i} " + " ".join("0" if aa == c else "*" for c in ALPHABETIC) + f" {i}", "100 2000 * 500 * 0 * 3000 0 1000", ""]
    return out


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    n = len(SEQUENCE)
    tpl = [f"SEQRES sequence = {SEQUENCE}", "//////////// Features", "head"]
    tpl += [f"{i} {aa} {int(i == 5)} {'HGIEBTSL'[i % 8]} A {i % 3} 10 3 4" + ("" if i == 5 else f" {3.8 * i} 0 0 {3.8 * i} 1 0") for i, aa in enumerate(SEQUENCE, 1)]
    tgt = [f"Sequence = {SEQUENCE}", "EVD =", "//////////// Original SS3+SS8+ACC file", "a", "b"]
    tgt += ["0.6 0.3 0.1 " + " ".join(["0.125"] * 8) + (" 0.005 0.96 0.035" if i in (2, 3) else " 0.5 0.005 0.495") for i in range(1, n + 1)]
    tgt += ["//////////// Original DIS file", "head", *[f"{i} A . . {0.21 if i == 3 else 0.2}" for i in range(1, n + 1)]]
    folders = [tmp_path_factory.mktemp(k) for k in ("tpl", "tgt")]
    (folders[0] / "one.tpl").write_text("\n".join(tpl + columns(SEQUENCE)))
    (folders[1] / "two.tgt").write_text("\n".join(tgt + columns(SEQUENCE)))
    a, b = (text_profiles.lines(spark, str(f)) for f in folders)
    templates = positions.template_positions(text_profiles.template_features(a), text_profiles.profile_columns(a), FLAT, NULL)
    targets = positions.target_positions(text_profiles.target_features(b), text_profiles.profile_columns(b), text_profiles.disorder(b), FLAT, NULL)
    return templates.cache(), targets.cache()


def test_positions(sides):
    t, u = ({r.pos: r for r in s.collect()} for s in sides)
    assert len(t) == len(u) == len(SEQUENCE)
    assert t[5].is_missing and t[5].ca is None and sum(t[5].ss3) == sum(t[5].ss8) == sum(t[5].acc) == 0
    assert (t[3].ss, t[3].ss3, t[3].ss8.index(1.0)) == (1, [0.0, 0.0, 1.0], 3)  # strand
    assert (t[8].ss, t[8].ss3) == (0, [0.0, 1.0, 0.0])  # helix
    assert (t[1].ss, t[1].ss3, t[1].acc, t[1].acc_class) == (2, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 1)
    assert t[22].aa_idx == 20 and t[22].own is None and sum(t[22].raw) == 0
    assert u[2].acc == [0.0, 1.0, 0.0] and u[2].acc_class == 1 and u[1].acc == [0.5, 0.0, 0.495] and u[1].acc_class == 0
    assert u[3].acc == [0.0, 0.0, 0.0] and u[3].acc_class == 1  # masked, but its class stays
    assert sum(u[3].ss8) == 0 and sum(u[2].ss8) == 1 and u[3].ss == 0  # disorder must exceed 0.2; the state stays


def test_features_by_hand(spark, sides):
    """One cell, and all cells whose window leaves the grid, against a plain loop."""
    pairs = spark.createDataFrame([(7, "one", "two"), (8, "one", "none")], "pair_id int, template_id string, target_id string")
    got = {(r.x, r.y): r.features for r in potentials.cell_features(pairs, *sides, NULL, ([float(i) for i in range(400)], [1.0] * 400)).collect()}
    t, u = ({r.pos: r for r in s.collect()} for s in sides)
    n = len(SEQUENCE)
    assert len(got) == n * n and all(len(f) == 396 for f in got.values())

    def m2(x, y):
        if not (1 <= x <= n and 1 <= y <= n):
            return 0.0
        m = sum(a * b * 4 for a, b in zip(t[x].p, u[y].p))
        return np.log(m) if m > 0 else -10.0

    for x, y in ((1, 1), (1, n), (n, n), (10, 10), (3, 9), (n, 4)):
        f = got[x, y]
        assert f[:20] == [int(10000 * a * b) for a, b in zip(t[x].raw, u[y].raw)]
        for k, w in enumerate(range(-5, 6)):
            part, near = f[20 + 8 * k : 28 + 8 * k], m2(x + w, y + w) + m2(x + w - 1, y + w - 1) + m2(x + w + 1, y + w + 1)
            assert abs(part[2] - int(1000 * near)) <= 1
            inside = 1 <= x + w <= n and 1 <= y + w <= n
            assert abs(part[0] - int(1000 * m2(x + w, y + w))) <= 1
            structure = f[110 + 26 * k : 136 + 26 * k]
            if not inside:
                assert part[:2] + part[3:] == [0] * 7 and structure == [0] * 26
            else:
                a, b = t[x + w], u[y + w]
                assert part[5] == 1000 * (a.ss == b.ss) and part[7] == 1000 * [3, 1, -2][abs(a.acc_class - b.acc_class)]
                assert structure == [int(1000 * i * j) for i in a.ss3 for j in b.ss3] + [int(1000 * i * j) for i, j in zip(a.ss8, b.ss8)] + [int(1000 * i * j) for i in a.acc for j in b.acc]
        known = t[x].aa_idx < 20 and u[y].aa_idx < 20
        assert f[108:110] == ([1000 * (t[x].aa_idx * 20 + u[y].aa_idx), 1000] if known else [0, 0])


def test_sparse_and_limit(spark):
    df = spark.createDataFrame([(1, [0, 5, 0, -2, 7])], "k int, features array<int>")
    whole, some = df.select(potentials.sparse("features"), potentials.sparse("features", 3)).first()
    assert [tuple(e) for e in whole] == [(0, 1), (2, 5), (4, -2), (5, 7)] and list(some) == list(whole)[:3]
    model = potential_queries.model()
    cut = spark.createDataFrame([(1, [0, 5, 0, -2, 0])], "k int, features array<int>")
    one, other = (potentials.potentials(d, model, {"m": 3}, 0.01, most).first().m for d, most in ((df, 3), (cut, None)))
    assert one == other
    w = model.hidden[3]
    by_hand = sum(model.outputs[3, g] / (1 + np.exp(-0.01 * (w[g, 0] + 5 * w[g, 2] - 2 * w[g, 4]))) for g in range(7))
    assert one == pytest.approx(by_hand)


def test_alignment_of_equal_sequences(spark, sides):
    """A model that rewards equal residues aligns the sequence with itself, but for the missing and the unknown residue."""
    hidden = np.zeros((8, 12, 398))
    hidden[:, :, 1:21] = 10.0  # products of raw probabilities are 10000 for equal residues
    outputs = np.zeros((8, 12))
    outputs[[0, 3, 6], 0] = 40.0
    outputs[[0, 3, 6], 1] = -26.0  # 7 with gates half open, else 14
    pairs = spark.createDataFrame([(1, "one", "two")], "pair_id int, template_id string, target_id string")
    scoring = tiles.Scoring(potentials.Model(outputs, hidden), NULL, NONE)
    scores, steps = chain.aligned(pairs, *sides, scoring)
    got = scores.collect()
    assert len(got) == 1 and got[0].raw > 0 and got[0].score > 0
    on = [(r.x, r.y) for r in steps.collect() if r.x and r.y]
    assert all(x == y for x, y in on) and 5 not in [x for x, _ in on] and 22 not in [x for x, _ in on] and got[0].lali >= len(on) >= 10
    none = spark.createDataFrame([], "pair_id int, template_id string, target_id string")
    assert [d.collect() for d in chain.aligned(none, *sides, scoring)] == [[], []]


def test_model_weights(spark, tmp_path):
    whole = spark.range(model_weights.WEIGHTS).select(F.col("id").alias("idx"), (F.col("id") / 7).alias("value"))
    whole.write.parquet(str(tmp_path / "model_param"))
    model = model_weights.read_model(spark, str(tmp_path / "model_param"))
    assert model.outputs[1, 2] == 14 / 7 and model.hidden[1, 2, 3] == (96 + (12 + 2) * 398 + 3) / 7
    for bad in (whole.where("idx <> 5"), whole.union(whole.where("idx = 5"))):
        with pytest.raises(ValueError):
            model_weights.model_weights(bad)


@pytest.mark.parametrize("mode", ["template", "target"])
def test_features_of_tiles(spark, sides, mode):
    """Those of every cell, whatever the tiles and however many cells at a time."""
    pairs = spark.createDataFrame([(7, "one", "two"), (8, "one", "none")], "pair_id int, template_id string, target_id string")
    tables, exchange = ([float(i) for i in range(400)], [-i / 3 for i in range(400)]), [i * 53 % 15 - 5.0 for i in range(400)]
    want = {(r.pair_id, r.x, r.y): r.features for r in potentials.cell_features(pairs, *sides, NULL, tables, mode, exchange).collect()}
    for size, most in ((128, 4096), (8, 20)):
        found = tiles.of_features(pairs, *sides, tiles.similarity_of(NULL, tables, mode, exchange), lambda f: [f[:, k].astype(np.int64) for k in range(396)], ", ".join(f"f{k} bigint" for k in range(396)), size, most)
        got = {tuple(r[:3]): list(r[3:]) for r in found.collect()}
        assert got.keys() == want.keys() and len(got) == len(SEQUENCE) ** 2
        assert np.abs(np.array([got[k] for k in want]) - np.array([want[k] for k in want])).max() == 0
