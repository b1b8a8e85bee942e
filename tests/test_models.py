"""Model files to prepared models and alignments, against plain arithmetic."""

import numpy as np
import pytest

from loomspan.operators import dynamic, models, profile
from loomspan.sources import text_profiles

LETTERS = profile.ALPHABETIC
FLAT = [[0.62 if a == b else 0.02 for b in range(20)] for a in range(20)]
NULL = [4322] * 20


def record(name, sequence, length=None, null=NULL, cut=0):
    """A model whose columns have their residue at 1/2 and all others at 1/64, but none of W; every third has a 0 for its
    effective number."""
    lines = [f"NAME  {name}", f"SEQ   {sequence}", f"LENG  {length or len(sequence)}", "NULL  " + "\t".join(map(str, null)), "HMM    A\tC\tD", "       M->M\tM->I", "   0\t*\t*\t0\t*\t0\t*\t2000\t0\t0"]
    for k, aa in enumerate(sequence, 1):
        lines.append(f"{aa} {k}\t" + "\t".join("1000" if c == aa else "*" if c == "W" else "6000" for c in LETTERS) + f"\t{k}")
        lines.append(f"  {100 + k}\t4000\t4100\t900\t1100\t1000\t1200\t{0 if k % 3 == 0 else 2500}\t1000\t500\n")
    return "\n".join(lines[: len(lines) - cut]) + "\n//\n"


@pytest.fixture(scope="module")
def columns(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("models")
    (at / "some.hhm").write_text(record("one", "ACDYKDDDDKLMNPQRST") + record("two", "ACDEFGHIKLMN"))
    (at / "bad.hhm").write_text(record("short", "ACDE", cut=2) + record("wrong", "ACDE", length=5) + record("null", "ACD", null=[1, 2]) + "NAME  empty\n//\n")
    return text_profiles.model_columns(text_profiles.model_records(spark, str(at))).cache()


def test_reader(columns):
    got = {(r.name, r.pos): r for r in columns.where("parse_error IS NULL").collect()}
    assert {k for k in got if k[0] == "two"} == {("two", k) for k in range(14)} and {k[0] for k in got} == {"one", "two"}
    assert got["two", 0].transitions == [0, None, None, 0, None, 0, None] and got["two", 0].neffs == [2, 0, 0] and got["two", 0].emissions == NULL
    assert got["two", 13].transitions is None and got["two", 13].neffs == [1, 0, 0] and got["two", 13].emissions == NULL
    assert got["two", 2].emissions[1] == 1000 and got["two", 2].emissions[LETTERS.index("W")] is None and got["two", 3].neffs == [1, 1, 0.5]
    errors = {r.name: r.parse_error for r in columns.where("parse_error IS NOT NULL").collect()}
    assert set(errors) == {"short", "wrong", "null", "empty"} and errors["empty"] == "no HMM block" and errors["null"] == "20 background values"


def by_hand(sequence, mode, tags=()):
    pb = np.full(20, 2.0**-4.322)
    f = np.array([[0.5 if c == aa else 0.0 if c == "W" else 2.0**-6 for c in LETTERS] for aa in sequence])
    for first, last in tags:
        f[first - 1 : last] = pb
    neff = np.array([1.0 if k % 3 == 0 else 2.5 for k in range(1, len(sequence) + 1)])
    x = neff / 1.5
    tau = {0: 0 * neff, 1: 0 * neff + 1.0, 2: np.minimum(1, 1 / (1 + x)), 3: np.maximum(0, (0.793 + 0.048 * (1.5 - 10)) * (1 - x + x * (1 - x)))}[mode]
    p = (1 - tau)[:, None] * f + tau[:, None] * (f @ np.array(FLAT).T)
    raw = 100 * pb / neff.mean() + p.sum(0)
    return p, raw / raw.sum(), neff.mean()


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_prepared(spark, columns, mode):
    tags = spark.createDataFrame([("one", 3, 10)], "name string, first int, last int")
    got = models.prepared(columns, FLAT, models.Pseudocounts(mode), tags).collect()
    for name, sequence, ranges in (("one", "ACDYKDDDDKLMNPQRST", [(3, 10)]), ("two", "ACDEFGHIKLMN", [])):
        rows = {r.pos: r for r in got if r.name == name}
        p, pav, neff = by_hand(sequence, mode, ranges)
        assert np.allclose([rows[k].p for k in range(1, len(sequence) + 1)], p)
        assert np.allclose(rows[0].p, pav) and np.allclose(rows[len(sequence) + 1].p, pav) and rows[1].neff == pytest.approx(neff)
        assert rows[len(sequence) + 1].transitions is None
        ends = [dict(zip(models.MOVES, rows[k].transitions, strict=True)) for k in (0, len(sequence))]
        assert all(z["mm"] == pytest.approx(0) and z["mi"] < -50000 and z["md"] < -50000 for z in ends) and ends[1]["dd"] < -50000
    if mode == 2:
        linear = {(r.name, r.pos): r.transitions for r in models.linear(models.prepared(columns, FLAT, tags=tags), 0.5).where("pos < 9").collect()}
        assert all(np.allclose(linear[r.name, r.pos], 2.0 ** (0.5 * np.array(r.transitions))) for r in got if r.pos < 9)


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_alignment_from_files(spark, columns, mode):
    """The same numbers as the plain programs on the prepared models; a background by each mode."""
    ready = models.prepared(columns, FLAT).cache()
    null = [1 / 20] * 20
    pairs = spark.createDataFrame([(1, "one", "two"), (2, "two", "two"), (3, "two", "none")], "pair_id int, query string, template string")
    got = {r.pair_id: r for r in models.aligned(pairs, ready, null, mode).collect()}
    assert set(got) == {1, 2}
    rows = {(r.name, r.pos): r for r in ready.collect()}
    for k, (q, t) in {1: ("one", "two"), 2: ("two", "two")}.items():
        lq, lt = rows[q, 0].length, rows[t, 0].length
        p, u = (np.array([rows[n, x].p for x in range(1, size + 1)]) for n, size in ((q, lq), (t, lt)))
        qp, tp = (np.array(rows[n, 0].pav) for n in (q, t))
        score = np.log2(p @ (u / {0: np.array(null), 1: (qp + tp) / 2, 2: tp, 3: qp}[mode]).T)
        phi = dynamic.pair_potentials(score, *(np.array([rows[n, x].transitions for x in range(size + 1)]) for n, size in ((q, lq), (t, lt))))
        value, path = dynamic.local_path(dynamic.PAIR, phi)
        total, post = dynamic.pair_posterior(phi, score)
        assert (got[k].score, got[k].total, got[k].posterior) == pytest.approx((value, total, post.sum()))
        assert got[k].path == " ".join(f"{s}:{x}:{y}" for s, x, y in path)
    assert got[2].path.split()[0].split(":")[1] == got[2].path.split()[0].split(":")[2]
