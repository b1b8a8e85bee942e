"""Alignments carried to fuller sequences, contacts, sums in log space."""

import math
import random

import numpy as np
import pytest

from loomspan.operators import dynamic, logsum, mapping


def test_identity():
    """Equal to the plain affine program, in batches of unlike lengths; neutral letters score 0."""
    rng = random.Random(1)
    a, b = (["".join(rng.choice("ABX.") for _ in range(rng.randint(0, 9))) for _ in range(60)] for _ in range(2))
    for x, y, got in zip(a, b, mapping.identity(a, b), strict=True):
        if not x or not y:
            assert got == []
            continue
        score = np.array([[0.0 if c in "X.Z" or d in "X.Z" else 10.0 if c == d else -15.0 for d in y] for c in x])
        _, path = dynamic.affine(score, -11.0, -1.0)
        assert got == [(i, j) for s, i, j in path if s == 0]


def test_carried(spark):
    """A gap in the known alignment, residues that a fuller sequence lacks, and nulls."""
    rows = [(1, "ABC-DE", "A-CFDE", "ZZABCDE", "ACFDEKK"), (2, "ABCDEF", "ABCDEF", "BCD", "xxABCDEF"), (3, None, "A", "A", "A"), (4, "AB", "AB", None, "AB")]
    df = spark.createDataFrame(rows, "pair_id long, a string, b string, full_a string, full_b string")
    steps, texts = mapping.carried(df)
    found = {p: [] for p in range(1, 5)}
    for r in steps.orderBy("pair_id", "step").collect():
        if r.x and r.y:
            found[r.pair_id].append((r.x, r.y))
    assert found == {1: [(3, 1), (5, 2), (6, 4), (7, 5)], 2: [(1, 4), (2, 5), (3, 6)], 3: [], 4: []}
    got = {r.pair_id: (r.a, r.b) for r in texts.collect()}
    assert got[1] == ("ZZABC-DE--", "--A-CFDEKK") and got[2] == ("---BCD--", "xxABCDEF"[:8])


def test_contacts(spark):
    rng = np.random.default_rng(2)
    points = [(int(k), i, [float(v) for v in rng.normal(0, 6, 3)] if i % 9 else None) for k in range(3) for i in range(60)] + [(0, 100, [1.0, 1.0, 1.0]), (0, 101, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(points, "chain long, pos int, ca array<double>")
    got = {(r.chain, r.i, r.j): r.distance for r in mapping.contacts(df, "chain", "pos", "ca", 5.0).collect()}
    want = {}
    for k, i, p in points:
        for m, j, q in points:
            if k == m and i < j and p and q and 0 < math.dist(p, q) < 5:
                want[k, i, j] = math.dist(p, q)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 50


def test_log_sums(spark, monkeypatch):
    monkeypatch.setattr(logsum, "HELD", 2)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, -math.inf, 1000.0, rng.uniform(-900, 900), 0.5])) for _ in range(300)] + [("none", None), ("low", -math.inf)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.lse for r in logsum.log_sum_exp_by(df, ["k"], "v").collect()}
    for k in {k for k, v in rows if v is not None}:
        values = [v for q, v in rows if q == k and v is not None]
        top = max(values)
        want = top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))
        assert got[k] == pytest.approx(want)
    assert "none" not in got and got["low"] == -math.inf
    assert logsum.log_sum_exp_by(df.limit(0), ["k"], "v").collect() == []
    plan = logsum.log_sum_exp_by(df.where("k = 'a'"), ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(k") == 1
