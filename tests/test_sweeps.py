"""Batched programs by diagonals, with all of them in memory and with blocks computed again, against whole tables."""

import numpy as np
import pytest

from loomspan.operators import dynamic, sweeps

ROOMS = [sweeps.ROOM, 0]


def tables(arrays):
    """[arc, pair, x, y] of tables of unlike size."""
    return np.ascontiguousarray(sweeps.padded(arrays, dynamic.NONE).transpose(1, 0, 2, 3))


@pytest.mark.parametrize("room", ROOMS)
@pytest.mark.parametrize("sizes", [[(30, 41), (25, 50), (1, 5), (4, 2)], [(3, 3)], [(70, 64), (61, 90)], [(1, 1), (2, 1)]])
def test_models(sizes, room):
    rng = np.random.default_rng(len(sizes))
    p, s = ([rng.dirichlet(np.ones(20) * 0.3, size=z[k]) + 1e-6 for z in sizes] for k in (0, 1))
    s = [z / 0.05 for z in s]
    q, t = ([np.log2(rng.dirichlet(np.ones(7), size=z[k] + 1)) for z in sizes] for k in (0, 1))
    got = sweeps.align_models(p, s, q, t, room=room)
    for b, z in enumerate(got):
        score = np.log2(p[b] @ s[b].T)
        phi = dynamic.pair_potentials(score, q[b], t[b])
        value, path = dynamic.local_path(dynamic.PAIR, phi)
        total, post = dynamic.pair_posterior(phi, score)
        gain, accurate = dynamic.most_accurate(post)
        assert (z.score, z.total, z.posterior, z.gain) == pytest.approx((value, total, post.sum(), max(gain, 0)))
        assert z.path == path
        if gain > 0:
            assert [c for c in z.accurate if c[0] == 0] == [c for c in accurate if c[0] == 0]


def test_empty_sides():
    none, one = np.zeros((0, 20)), np.full((2, 20), 0.5)
    tr = [np.zeros((3, 7))] * 2
    got = sweeps.align_models([none, one], [one, one], tr, tr)
    assert (got[0].score, got[0].path, got[0].total) == (0.0, [], 0.0) and got[1].path
    assert sweeps.align_models([], [], [], []) == []


@pytest.mark.parametrize("room", ROOMS)
@pytest.mark.parametrize("sizes", [[(7, 9), (12, 5), (10, 10)], [(40, 33)], [(1, 1)]])
def test_three_states(sizes, room):
    rng = np.random.default_rng(7)
    phis = [dynamic.three_state(rng.normal(0, 2, size=z), -2.0, -1.0, -2.5, -0.7, -1.2) for z in sizes]
    sweep = sweeps.Sweep(dynamic.THREE, np.array(sizes), sweeps.from_table(tables(phis)), room)
    value, paths = sweep.best("whole")
    once, same = sweep.best("whole", once=True)
    assert same == paths and (once == value).all()
    forward = sweep.forward()
    post = [np.zeros((3, x + 1, y + 1)) for x, y in sizes]
    for d, p in forward.posterior(sweeps.at_end(sweep), forward.whole):
        for b, (lx, ly) in enumerate(sizes):
            for x in range(max(0, d - ly), min(lx, d) + 1):
                post[b][:, x, d - x] = p[:, b, x + 1]
    for b, (lx, ly) in enumerate(sizes):
        best, arc = dynamic.THREE.best(phis[b], False)
        end = best[:, lx, ly]
        assert end.max() == pytest.approx(value[b]) and dynamic.THREE.trace(arc, (int(end.argmax()), lx, ly)) == paths[b]
        z, whole = dynamic.posterior(dynamic.THREE, phis[b])
        assert z == pytest.approx(forward.whole[b]) and np.allclose(whole, post[b])


def test_memory_of_long_pairs():
    """Diagonals that are kept grow with the square root of their number, not with the product of lengths."""
    models = sweeps.Models(np.array([(1500, 1500)]), lambda d, x0, x1: np.zeros((1, x1 - x0 + 1)), [np.zeros((1501, 7))], [np.zeros((1501, 7))])
    sweep = sweeps.Sweep(dynamic.PAIR, models.lengths, models, room=0)
    forward = sweep.forward(models.started)
    assert len(forward.saved) <= 56 and not forward.kept and sweep.block <= 56


def accuracy_by_loops(post, follows, at, radius):
    """The program cell by cell: values and the last match of the path to each state."""
    lx, ly = post.shape
    value, last = np.zeros((3, lx + 1, ly + 1)), np.zeros((3, lx + 1, ly + 1), int)
    for x in range(lx + 1):
        for y in range(ly + 1):
            for s, t in dynamic.THREE.arcs:
                ex, ey = dynamic.THREE.steps[t]
                if x < ex or y < ey:
                    continue
                new, known = value[s, x - ex, y - ey], last[s, x - ex, y - ey]
                if t == 0:
                    away = np.sqrt(((at[known - 1] - at[x - 1]) ** 2).sum()) if known else 0
                    if known and not (s == 0 and follows[x - 1]) and not 0 < away < radius:
                        continue
                    new += post[x - 1, y - 1]
                if new > value[t, x, y]:
                    value[t, x, y], last[t, x, y] = new, x if t == 0 else known if t == 1 else 0
    return value.max()


@pytest.mark.parametrize("room", ROOMS)
def test_accuracy_under_the_chain(room):
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = [tuple(int(n) for n in rng.integers(1, 9, 2)) for _ in range(3)]
        post = [rng.random(z) ** 2 for z in sizes]
        follows, at = [rng.random(z[0]) < 0.4 for z in sizes], [np.cumsum(rng.normal(0, 2.5, size=(z[0], 3)), 0) for z in sizes]
        value, found = sweeps.accurate_under_chain(post, follows, at, 7.0, room)
        for b in range(3):
            assert value[b] == pytest.approx(accuracy_by_loops(post[b], follows[b], at[b], 7.0))
            assert sum(post[b][x - 1, y - 1] for s, x, y in found[b] if s == 0) == pytest.approx(value[b])
            before = None
            for s, x, _ in found[b]:
                if s == 0:
                    assert before is None or (in_a_row and follows[b][x - 1]) or 0 < np.sqrt(((at[b][before - 1] - at[b][x - 1]) ** 2).sum()) < 7.0
                    before = x
                elif s == 2:
                    before = None
                in_a_row = s == 0


def pair_paths(phi, x, y, state, free, closed):
    """All paths from a cell on, as (value, cells); ``free`` ones end with a match in the last row or column."""
    lx, ly = phi.shape[1] - 1, phi.shape[2] - 1
    for m, (s, t) in enumerate(dynamic.PAIR.arcs):
        ex, ey = dynamic.PAIR.steps[t]
        cell = (x + ex, y + ey)
        if s == state and cell[0] <= lx and cell[1] <= ly and cell not in closed and np.isfinite(phi[(m, *cell)]):
            w = float(phi[(m, *cell)])
            if t == 0 and (not free or lx == cell[0] or ly == cell[1]):
                yield w, [(t, *cell)]
            for more, rest in pair_paths(phi, *cell, t, free, closed):
                yield w + more, [(t, *cell), *rest]


@pytest.mark.parametrize("mode", ["local", "free"])
def test_alternatives(mode):
    """The best path of all by enumeration, then the best that keeps away from it, and so on; no two meet."""
    rng = np.random.default_rng(11)
    for _ in range(6):
        lx, ly = (int(n) for n in rng.integers(2, 5, 2))
        p, s = rng.dirichlet(np.ones(4), size=lx), rng.dirichlet(np.ones(4), size=ly) / 0.25
        q, t = (np.log2(rng.dirichlet(np.ones(7), size=n + 1)) for n in (lx, ly))
        phi = dynamic.pair_potentials(np.log2(p @ s.T) + 2, q, t)
        got = sweeps.alternatives([p], [s * 4], [q], [t], 3, mode)[0]
        closed = set()
        for value, path in got:
            starts = [(x, y) for x in range(lx + 1) for y in range(ly + 1) if mode == "local" or not x or not y]
            if mode == "local":
                best = max((v for x, y in starts for st in range(5) for v, _ in pair_paths(phi, x, y, st, False, closed)), default=0)
            else:
                best = max(v for x, y in starts for v, _ in pair_paths(phi, x, y, 0, True, closed))
            assert value == pytest.approx(best)
            assert not closed & {(x, y) for _, x, y in path}
            closed |= {c for _, x, y in path for k in range(-2, 3) for c in ((x + k, y), (x, y + k))}
    assert sweeps.alternatives([np.zeros((0, 4))], [s], [q], [t], 2, mode) == [[]]


def test_alternatives_of_several_modes_share_weights(monkeypatch):
    """Each mode's paths are those it finds alone, whether weights of diagonals are kept or not; scores are computed once."""
    rng = np.random.default_rng(11)
    sizes = [(9, 7), (5, 12), (11, 11)]
    p, s = ([rng.random((n[k], 4)) + 0.1 for n in sizes] for k in (0, 1))
    q, t = ([np.log2(rng.random((n[k] + 1, 7)) * 0.5 + 0.4) for n in sizes] for k in (0, 1))
    asked = []
    known = sweeps.column_scores

    def counted(*sides):
        score = known(*sides)
        return lambda d, x0, x1: asked.append(d) or score(d, x0, x1)

    alone = [sweeps.alternatives(p, [z * 4 for z in s], q, t, 3, mode) for mode in ("local", "free")]
    monkeypatch.setattr(sweeps, "column_scores", counted)
    assert sweeps.alternatives(p, [z * 4 for z in s], q, t, 3, ("local", "free")) == alone
    assert len(asked) == len(set(asked)) and any(len(x) > 1 for mode in alone for x in mode)
    assert sweeps.alternatives(p, [z * 4 for z in s], q, t, 3, ("local", "free"), room=3000) == alone
