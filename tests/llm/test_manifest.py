"""Hash trees against plain loops, for several arities and block heights."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, place long, digest string, key long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    """The root and, for each node, the siblings before and after on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, place in zip(paths, at, strict=True):
            run, own = nodes[place // arity * arity :][:arity], place % arity
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        nodes = [sha("".join(nodes[k : k + arity])) for k in range(0, len(nodes), arity)]
        at = [place // arity for place in at]
    return nodes[0], paths


def by_hand(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row)))
    groups = {g: sorted(groups[g]) for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode()))}
    trees = {g: tree([x[2] for x in leaves], arity) for g, leaves in groups.items()}
    root, tops = tree([t[0] for t in trees.values()], arity)
    return sorted((known, doc_id, digest, trees[g][0], root, path + top) for top, (g, leaves) in zip(tops, groups.items(), strict=True) for (known, doc_id, digest), path in zip(leaves, trees[g][1], strict=True))


def made(n, seed=1):
    rng = random.Random(seed)
    langs = [None, "", "en", "en", "en", "é", "zh", "A"]
    rows = [(rng.choice([k, k % 50, None]), rng.choice(["web", None, ""]), rng.choice(langs), rng.choice([k, None]), rng.choice([f"Text {k} ü", "", None])) for k in range(n)]
    return rows + [(7, "web", "en", 3, "again")] * (n // 3)


@pytest.mark.parametrize(("arity", "levels", "n"), [(2, 10, 60), (2, 2, 200), (3, 1, 90), (2, 10, 1)])
def test_trees(spark, arity, levels, n):
    rows = made(n)
    df = spark.createDataFrame([(*r, "g", 0, "d", 0) for r in rows], SCHEMA)
    got = manifest.manifest(df, "doc_id", "lang", manifest.FIELDS, {"again": F.col("n_chars")}, arity, levels)
    got = got.withColumn("folded", manifest.folded(F.col("leaf"), F.col("steps"))).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in got) == by_hand(rows, arity)
    assert {r.folded for r in got} == {got[0].root}


def test_wide_joins(spark, monkeypatch):
    """Paths that are too many to broadcast."""
    monkeypatch.setattr(manifest, "BROADCAST_ROWS", 0)
    rows = made(40)
    got = manifest.manifest(spark.createDataFrame([(*r, "g", 0, "d", 0) for r in rows], SCHEMA), "doc_id", "lang", manifest.FIELDS, levels=2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in got) == by_hand(rows, 2)


def test_no_rows(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA), "doc_id", "lang", manifest.FIELDS).collect() == []


def test_tampered_rows(spark, sf):
    rows = manifest.op12_manifest(spark, sf).collect()
    assert 0 < sum(not r.verified for r in rows) < len(rows) / 3
    assert all((r.folded_root == r.root) == r.verified for r in rows)
