"""Tiles of cells and the chained program against the cell-by-cell features and plain loops."""

import numpy as np
import pytest
from plain_search import searched_by_steps, steps_of
from pyspark.sql import functions as F

from loomspan.operators import chain, dynamic, potentials, refine, tiles
from loomspan.operators.profile import ALPHABETIC, MATRIX_ORDER
from loomspan.plans import potential_queries as pq

P = dynamic.PENALTIES["template"]
MODEL = pq.model(60.0)


@pytest.fixture(scope="module")
def given(spark, sf):
    """Two profiles of 50 positions and one of 23; three pairs."""
    rows = pq.positions(spark, sf).where("profile_id < 2 OR (profile_id = 2 AND pos <= 23)").cache()
    pairs = spark.createDataFrame([(10, 0, 1), (11, 2, 0), (12, 1, 1), (13, 0, 99)], "pair_id long, template_id long, target_id long")
    return pairs, rows


@pytest.mark.parametrize("mode", ["template", "target"])
@pytest.mark.parametrize(("size", "most"), [(128, None), (7, None), (16, 60)])
def test_tiles(given, mode, size, most):
    """Tiles of any size, with all entries of a cell or its first ones, equal the features times the gates."""
    pairs, rows = given
    features = potentials.cell_features(pairs, rows, rows, pq.NULL, pq.TABLES, mode, pq.SUBSTITUTION)
    want = {(r.pair_id, r.x, r.y): r for r in potentials.potentials(features, MODEL, potentials.MATCH, potentials.MATCH_SCALE, most).collect()}
    scoring = tiles.Scoring(MODEL, pq.NULL, pq.TABLES, mode, pq.SUBSTITUTION, most)
    got = {(r.pair_id, r.x, r.y): r for r in tiles.cell_potentials(pairs, rows, rows, scoring, size).collect()}
    assert set(got) == set(want) and len(got) == 50 * 50 + 23 * 50 + 50 * 50
    assert max(abs(got[k][c] - want[k][c]) for k in want for c in potentials.MATCH) < 1e-9
    some = spark_cells(pairs, [(10, 1, 1), (10, 50, 50), (10, 8, 14), (11, 23, 1), (11, 9, 9)])
    few = tiles.cell_potentials(pairs, rows, rows, scoring, size, some).collect()
    assert len(few) == 5 and all(abs(r.m1 - want[r.pair_id, r.x, r.y].m1) < 1e-9 for r in few)


def spark_cells(pairs, cells):
    return pairs.sparkSession.createDataFrame(cells, "pair_id long, x int, y int")


def test_frequent_profile(spark, given, monkeypatch):
    """A profile of most pairs is dealt by a salt, and nothing is lost or doubled."""
    monkeypatch.setattr(tiles, "SHARE", 2)
    _, rows = given
    pairs = spark.createDataFrame([(k, 2, k % 2) for k in range(8)], "pair_id long, template_id long, target_id long")
    got = tiles.cell_potentials(pairs, rows, rows, tiles.Scoring(MODEL, pq.NULL, pq.TABLES)).groupBy("pair_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(k, 23 * 50) for k in range(8)]


def mended_by_hand(found, a, b, known_a, known_b):
    """Blocks in order: the residues before it and behind it, as long as they are free, equal and standard."""
    mate, used = dict(found), {y for _, y in found}
    blocks, cells = [], sorted(found)
    for x, y in cells:
        if blocks and blocks[-1][-1] == (x - 1, y - 1):
            blocks[-1].append((x, y))
        else:
            blocks.append([(x, y)])
    for block in blocks:
        for (x, y), step in ((block[0], -1), (block[-1], 1)):
            x, y = x + step, y + step
            while 1 <= x <= len(a) and 1 <= y <= len(b) and x not in mate and y not in used and a[x - 1] == b[y - 1] and a[x - 1] in ALPHABETIC:
                mate[x] = y
                used.add(y)
                x, y = x + step, y + step
    return {(x, y) for x, y in mate.items() if known_a[x - 1] and known_b[y - 1]}


def scored_by_hand(steps, match, gap_x, gap_y):
    on = [k for k, (x, y) in enumerate(steps) if min(x, y) > 0]
    score, before, lali = 0.0, 0, 0
    for x, y in steps[on[0] : on[-1] + 1] if on else []:
        if min(x, y) > 0:
            score, before, lali = score + np.clip(match[before, x - 1, y - 1], *P["clip"]) + P["mm"], 0, lali + 1
        elif x > 0:
            score += {0: gap_x[0, x - 1] + P["mi"], 1: gap_x[1, x - 1] + P["ii"], 2: 0.0}[before]
            before = 1
        else:
            score += {0: gap_y[0, y - 1] + P["md"], 1: gap_y[2, y - 1] + P["id"], 2: gap_y[1, y - 1] + P["dd"]}[before]
            before, lali = 2, lali + 1
    return max(0.0, score) / P["divisor"], lali


@pytest.mark.parametrize("size", [128, 9])
def test_whole_program(spark, given, size):
    """Every number of the chain, from potentials in tables; tiles that hold a whole pair, and small ones."""
    pairs, rows = given
    scoring = tiles.Scoring(MODEL, pq.NULL, pq.TABLES)
    known = [(p, x, x + p - 10) for p in (10, 11) for x in range(1, 24) if x % 5] + [(10, 40, None)]
    truth = spark.createDataFrame(known, "pair_id long, x int, y int")
    got = chain.run(pairs, rows, rows, scoring, truth, size=size)
    scores, overlap = ({r.pair_id: r for r in df.collect()} for df in (got.scores, got.overlap))
    cells = {}
    for r in tiles.cell_potentials(pairs, rows, rows, scoring).collect():
        cells.setdefault(r.pair_id, {})[r.x, r.y] = (r.m0, r.m1, r.m2)
    sides = [{(r.profile_id, r.pos): r for r in df.collect()} for df in chain.with_gaps(rows, rows, scoring)]
    assert set(scores) == set(overlap) == {10, 11, 12}
    before, after = ({p: [(r.x, r.y) for r in sorted(df.where(f"pair_id = {p}").collect(), key=lambda r: r.step)] for p in scores} for df in (got.before, got.after))
    for p, t, u in ((10, 0, 1), (11, 2, 0), (12, 1, 1)):
        lx, ly = (23 if k == 2 else 50 for k in (t, u))
        a, b = [sides[0][t, x] for x in range(1, lx + 1)], [sides[1][u, y] for y in range(1, ly + 1)]
        match = np.array([[cells[p][x, y] for y in range(1, ly + 1)] for x in range(1, lx + 1)]).transpose(2, 0, 1)
        gap_x, gap_y = np.array([[r.mi, r.ii] for r in a]).T, np.array([[r.md, r.dd, r.id] for r in b]).T
        on = np.array([r.known for r in a])[:, None] & np.array([r.known for r in b])[None]
        ca = np.array([[np.nan] * 3 if r.ca is None else r.ca for r in a], float)
        away = np.sqrt(((ca[:, None] - ca[None]) ** 2).sum(2))
        raw, _, _ = dynamic.constrained(match, gap_x, gap_y, on, np.array([bool(r.follows) for r in a]), np.where(np.isnan(away), dynamic.RADIUS, away))
        path = chain.best_paths(chain.laid_tiles(pairs.where(f"pair_id = {p}"), *chain.with_gaps(rows, rows, scoring), scoring, size), size).first()
        assert scores[p].raw == pytest.approx(raw) and path.raw == pytest.approx(raw) and (scores[p].lx, scores[p].ly) == (lx, ly)
        letters = [["X" if r.aa_idx == 20 else MATRIX_ORDER[r.aa_idx] for r in z] for z in (a, b)]
        found = mended_by_hand({(s.x, s.y) for s in path.path if s.state == 0}, *letters, [r.known for r in a], [r.known for r in b])
        steps = steps_of(found, lx, ly)
        assert before[p] == [(x if x > 0 else None, y if y > 0 else None) for x, y in steps]
        assert (scores[p].score, scores[p].lali) == pytest.approx(scored_by_hand(steps, match, gap_x, gap_y))
        want = {(x, y) for q, x, y in known if q == p and y}
        later = found
        if want:
            later = searched_by_steps(chain._table(match, gap_x, gap_y)(0, lx, 0, ly), found, want, refine.RANGE, refine.DEPTH)
        assert {(x, y) for x, y in after[p] if x and y} == later
        assert tuple(overlap[p])[1:] == (len(want), len(found), len(found & want), len(later & want))
    assert sum(overlap[p].after for p in overlap) > sum(overlap[p].before for p in overlap)


def test_fasta(spark, given, tmp_path):
    """Alignments written as files read back as they were."""
    from loomspan.operators import alignment
    from loomspan.sources import text_profiles, writers

    pairs, rows = given
    steps = spark.createDataFrame([(10, k, x, y) for k, (x, y) in enumerate([(1, 1), (2, None), (None, 2), (3, 3)])], "pair_id long, step int, x int, y int")
    texts = chain.sequences(pairs, rows, rows)
    writers.write_fasta(chain.fasta(steps, texts), str(tmp_path / "out"))
    back = text_profiles.fasta_alignments(spark, str(tmp_path / "out" / "*.txt")).where("a <> ''").collect()
    assert [(r.name_a, r.name_b, len(r.a), r.a.count("-"), r.b.count("-"), r.parse_error) for r in back] == [("0", "1", 4, 1, 1, None)]
    again = alignment.from_gapped(spark.createDataFrame([(10, back[0].a, back[0].b)], "pair_id long, a string, b string"), "pair_id", "a", "b")
    assert [(r.step, r.x, r.y) for r in again.orderBy("step").collect()] == [(0, 1, 1), (1, 2, None), (2, None, 2), (3, 3, 3)]
    assert steps.where(F.col("x").isNull()).count() == 1
