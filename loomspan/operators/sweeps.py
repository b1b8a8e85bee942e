"""Dynamic programs over batches of pairs of like length, by anti-diagonals, in memory that grows as length to the power 1.5.

``dynamic`` states the programs over whole tables and is what tests hold these against. Here a diagonal of all pairs of a
batch is one array [state, pair, x], weights come diagonal by diagonal from a function, and only the two last diagonals go
on. Where all diagonals don't fit ``ROOM``, the two before each block of about the square root of their number are kept, and
a block's diagonals are computed again when the way back needs them. Cells outside a pair's lengths weigh minus infinity.

A batch's x and y are its longest pairs'. Tables are padded by one column on the left, so x lies at index x + 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.dynamic import LEAST_POSTERIOR, NONE, PAIR, SHIFT, THREE, Machine, Path

#: Bytes of diagonals that are kept; beyond it, blocks are computed again.
ROOM = 64 << 20
Diagonal = Callable[[int, int, int], np.ndarray]


@dataclass
class Geometry:
    """A match is allowed if it follows one in a structure that goes on, if none comes before in the path (or a residue of
    y alone lies between), or if the chain's coordinates come closer to the last match than ``radius``, but not to 0."""

    follows: np.ndarray  # [pair, x]
    at: np.ndarray  # [pair, x, 3], not a number where a residue is missing
    radius: float

    def allows(self, state: int, last: np.ndarray, x0: int, x1: int) -> np.ndarray:
        """Of matches at x0..x1 (from 1), by the last match of the path that leads there (0: none)."""
        pair = np.arange(len(last))[:, None]
        away = np.sqrt(((self.at[pair, np.maximum(last - 1, 0)] - self.at[:, x0 - 1 : x1]) ** 2).sum(2))
        near = (last <= 0) | ((away > 0) & (away < self.radius))
        return near | self.follows[:, x0 - 1 : x1] if state == 0 else near


@dataclass
class Sweep:
    """Programs of a machine over a batch whose weights into the cells x0..x1 of diagonal d are ``weights(d, x0, x1)``, an
    array [arc, pair, x]."""

    machine: Machine
    lengths: np.ndarray  # [pair, 2]
    weights: Diagonal
    room: int = ROOM
    lx: int = field(init=False)
    ly: int = field(init=False)
    block: int = field(init=False)

    def __post_init__(self) -> None:
        self.lx, self.ly = (int(n) for n in self.lengths.max(0))
        self.states, self.pairs = len(self.machine.steps), len(self.lengths)
        each = self.states * self.pairs * (self.lx + 2) * 8
        self.block = self.count if each * self.count <= self.room else math.isqrt(self.count) + 1
        # A cell's arcs as one number: for each state the place of its arc among those that lead there, or 0 for a start.
        self.into = [[m for m, (_, t) in enumerate(self.machine.arcs) if t == k] for k in range(self.states)]
        bits = [len(arcs).bit_length() for arcs in self.into]
        self.shifts, self.masks = np.cumsum([0, *bits[:-1]]).tolist(), [(1 << b) - 1 for b in bits]
        self.packed = np.uint8 if sum(bits) <= 8 else np.uint16
        self.codes = [self.packed((self.into[t].index(m) + 1) << self.shifts[t]) for m, (_, t) in enumerate(self.machine.arcs)]

    @property
    def count(self) -> int:
        return self.lx + self.ly + 1

    def span(self, d: int) -> tuple[int, int]:
        return max(0, d - self.ly), min(self.lx, d)

    def empty(self, value: float = NONE) -> np.ndarray:
        return np.full((self.states, self.pairs, self.lx + 2), value)

    def across(self, value: float, kind: type = float) -> np.ndarray:
        """As ``empty``, with the pairs beside each other in memory: spans of all pairs are one run, which best paths gain by."""
        return np.full((self.states, self.lx + 2, self.pairs), value, kind).transpose(0, 2, 1)

    def inside(self, d: int) -> np.ndarray:
        """[pair, x]: the cells of a diagonal within each pair's lengths."""
        x0, x1 = self.span(d)
        x = np.arange(x0, x1 + 1)
        return (x <= self.lengths[:, :1]) & (d - x <= self.lengths[:, 1:])

    def _arcs(self, d: int) -> Iterator[tuple[int, int, int, int, slice, slice]]:
        """Arc, its states, how many diagonals it goes back, and the columns that it leads to and from."""
        for m, (s, t) in enumerate(self.machine.arcs):
            ex, ey = self.machine.steps[t]
            x0, x1 = max(ex, d - self.ly), min(self.lx, d - ey)
            if x0 <= x1:
                yield m, s, t, ex + ey, slice(x0 + 1, x1 + 2), slice(x0 + 1 - ex, x1 + 2 - ex)

    def _blocks(self) -> Iterator[range]:
        for a in range(0, self.count, self.block):
            yield range(a, min(self.count, a + self.block))

    # Best paths.

    def _best_step(self, d: int, before: tuple, mode: str, geometry: Geometry | None) -> tuple:
        """A diagonal's values, the last match on each one's path, and the packed arcs that gave them."""
        x0, x1 = self.span(d)
        value, arcs = self.across(NONE), self.across(0, self.packed)
        last = None if geometry is None else np.zeros(value.shape, np.int32)
        if mode == "local":
            value[:, :, x0 + 1 : x1 + 2] = 0
        if mode == "free":
            value[0, :, [x + 1 for x in {0, d} if x0 <= x <= x1]] = 0
        if d == 0:
            value[0, :, 1] = 0
        weights = self.weights(d, x0, x1)
        for m, s, t, back, to, fro in self._arcs(d):
            source, from_last, _ = before[back - 1]
            new = source[s][:, fro] + weights[m][:, to.start - 1 - x0 : to.stop - 1 - x0]
            better = new > value[t][:, to]
            if geometry is not None:
                known = from_last[s][:, fro]
                if t == 0:
                    better &= geometry.allows(s, known, to.start - 1, to.stop - 2)
                carried = np.broadcast_to(np.arange(to.start - 1, to.stop - 1), known.shape) if t == 0 else known if self.machine.steps[t] == (1, 0) else 0
                np.copyto(last[t][:, to], carried, where=better, casting="unsafe")
            if geometry is not None:
                np.copyto(value[t][:, to], new, where=better)
            else:
                np.maximum(value[t][:, to], new, out=value[t][:, to])
            # A state's arcs come in rising order, so the largest is the one that was better last.
            np.maximum(arcs[t][:, to], np.multiply(better, self.codes[m], dtype=self.packed), out=arcs[t][:, to])
        return value, last, np.bitwise_or.reduce(arcs[:, :, x0 + 1 : x1 + 2])

    def _outside(self, geometry: Geometry | None) -> tuple:
        return self.across(NONE), None if geometry is None else np.zeros((self.states, self.pairs, self.lx + 2), np.int32), None

    def best(self, mode: str = "whole", geometry: Geometry | None = None, order: tuple[int, ...] | None = None, once: bool = False) -> tuple[np.ndarray, list[Path]]:
        """The best value and path of each pair.

        ``whole`` paths lead from the first cell to the last; ``local`` ones begin and end anywhere, with a value above 0;
        ``free`` ones begin in state 0 before the first residue of a side and end in it with the last residue of a side. Of
        equal ends the first one by the states' ``order``, then x, then y, is taken. With ``once`` weights are asked for
        once, from the first diagonal to the last, and all packed arcs are kept: a byte or two for each cell."""
        order, once = order or tuple(range(self.states)), once or self.block == self.count
        top, at = np.full(self.pairs, NONE), np.full((self.pairs, 3), -1)
        saved, kept = [], {}
        recent = (self._outside(geometry), self._outside(geometry))
        for d in range(self.count):
            if d % self.block == 0:
                saved.append(recent)
            new = self._best_step(d, recent, mode, geometry)
            recent = (new, recent[0])
            if once:
                kept[d] = new[2]
            self._ends(d, new[0], mode, order, top, at)
        value = np.where(np.isfinite(top), top, NONE)
        open_ = {b: (int(s), int(x), int(y)) for b, (s, x, y) in enumerate(at) if s >= 0 and not (mode == "local" and top[b] <= 0)}
        paths: list[Path] = [[] for _ in range(self.pairs)]
        for number, block in reversed(list(enumerate(self._blocks()))):
            if not any(x + y >= block[0] for _, x, y in open_.values()):
                continue
            if not once:
                recent, kept = saved[number], {}
                for d in block:
                    new = self._best_step(d, recent, mode, geometry)
                    recent, kept[d] = (new, recent[0]), new[2]
            for b, (s, x, y) in list(open_.items()):
                while x + y >= block[0]:
                    k = int(kept[x + y][b, x - self.span(x + y)[0]]) >> self.shifts[s] & self.masks[s]
                    if not k:
                        del open_[b]
                        break
                    paths[b].append((s, x, y))
                    ex, ey = self.machine.steps[s]
                    s, x, y = self.machine.arcs[self.into[s][k - 1]][0], x - ex, y - ey
                else:
                    open_[b] = (s, x, y)
        return value, [p[::-1] for p in paths]

    def _ends(self, d: int, value: np.ndarray, mode: str, states: tuple[int, ...], top: np.ndarray, at: np.ndarray) -> None:
        x0, x1 = self.span(d)
        if mode != "whole":
            good = self.inside(d)
            if mode == "free":
                x, states = np.arange(x0, x1 + 1), (0,)
                good = good & ((x == self.lengths[:, :1]) | (d - x == self.lengths[:, 1:])) & (x > 0) & (d > x)
            here = np.where(good, value[list(states), :, x0 + 1 : x1 + 2], NONE)
            most = here.max((0, 2))
            for b in np.flatnonzero((most >= top) & np.isfinite(most)):
                k, i = np.unravel_index(int(here[:, b].argmax()), here[:, b].shape)
                place = (int(k), x0 + int(i), d - x0 - int(i))
                own = (states.index(int(at[b, 0])), *at[b, 1:]) if at[b, 0] >= 0 else None
                if most[b] > top[b] or own is None or place < tuple(map(int, own)):
                    top[b], at[b] = most[b], (states[place[0]], *place[1:])
        else:
            for b in np.flatnonzero(self.lengths.sum(1) == d):
                x = int(self.lengths[b, 0])
                here = value[list(states), b, x + 1]
                if np.isfinite(here.max()):
                    top[b], at[b] = here.max(), (states[int(here.argmax())], x, d - x)

    # Sums over paths.

    def _sum_step(self, d: int, before: tuple[np.ndarray, np.ndarray], start: Diagonal | None) -> np.ndarray:
        x0, x1 = self.span(d)
        value = self.empty()
        if start is not None:
            value[:, :, x0 + 1 : x1 + 2] = start(d, x0, x1)
        elif d == 0:
            value[0, :, 1] = 0
        weights = self.weights(d, x0, x1)
        for m, s, t, back, to, fro in self._arcs(d):
            np.logaddexp(value[t][:, to], before[back - 1][s][:, fro] + weights[m][:, to.start - 1 - x0 : to.stop - 1 - x0], out=value[t][:, to])
        return value

    def forward(self, start: Diagonal | None = None) -> Forward:
        """Log sums over all paths into each cell; ``start`` has those that begin in one, by default in the first."""
        saved, kept, total = [], {}, np.full((self.pairs, 2), NONE)
        recent = (self.empty(), self.empty())
        for d in range(self.count):
            if d % self.block == 0:
                saved.append(recent)
            recent = (self._sum_step(d, recent, start), recent[0])
            if self.block == self.count:
                kept[d] = recent[0]
            x0, x1 = self.span(d)
            total[:, 0] = np.logaddexp(total[:, 0], np.logaddexp.reduce(np.where(self.inside(d), recent[0][0, :, x0 + 1 : x1 + 2], NONE), axis=1))
            for b in np.flatnonzero(self.lengths.sum(1) == d):
                total[b, 1] = np.logaddexp.reduce(recent[0][:, b, int(self.lengths[b, 0]) + 1])
        return Forward(self, start, saved, kept, total[:, 0], total[:, 1])


@dataclass
class Forward:
    """Forward sums: ``matched`` is the sum over all cells in state 0, ``whole`` that over the last cell of each pair."""

    sweep: Sweep
    start: Diagonal | None
    saved: list
    kept: dict[int, np.ndarray]
    matched: np.ndarray
    whole: np.ndarray

    def block(self, number: int, diagonals: range) -> dict[int, np.ndarray]:
        if self.sweep.block == self.sweep.count:
            return self.kept
        recent, out = self.saved[number], {}
        for d in diagonals:
            recent = (self.sweep._sum_step(d, recent, self.start), recent[0])
            out[d] = recent[0]
        return out

    def posterior(self, end: Diagonal, total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """From the last diagonal to the first: d and the probability of each (state, pair, x at index x + 1).

        ``end`` has the log weights of stopping in a cell; ``total`` the log of the sum over all paths."""
        sweep = self.sweep
        ahead = [sweep.empty(), sweep.empty(), sweep.empty()]  # this diagonal and the two before it
        for number, block in reversed(list(enumerate(sweep._blocks()))):
            sums = self.block(number, block)
            for d in reversed(block):
                x0, x1 = sweep.span(d)
                here = ahead[0][:, :, x0 + 1 : x1 + 2]
                np.logaddexp(here, end(d, x0, x1), out=here)
                weights = sweep.weights(d, x0, x1)
                for m, s, t, back, to, fro in sweep._arcs(d):
                    there = ahead[back][s][:, fro]
                    np.logaddexp(there, ahead[0][t][:, to] + weights[m][:, to.start - 1 - x0 : to.stop - 1 - x0], out=there)
                with np.errstate(invalid="ignore"):
                    yield d, np.exp(sums[d] + ahead[0] - total[:, None])
                ahead = [ahead[1], ahead[2], sweep.empty()]


def at_end(sweep: Sweep) -> Diagonal:
    """Stopping in the last cell of each pair only, in any state."""

    def end(d: int, x0: int, x1: int) -> np.ndarray:
        x = np.arange(x0, x1 + 1)
        last = (x == sweep.lengths[:, :1]) & (d - x == sweep.lengths[:, 1:])
        return np.broadcast_to(np.where(last, 0.0, NONE), (sweep.states, *last.shape))

    return end


def in_matches(sweep: Sweep) -> Diagonal:
    """Stopping in any cell that matches a residue of each side."""

    def end(d: int, x0: int, x1: int) -> np.ndarray:
        x = np.arange(x0, x1 + 1)
        out = np.full((sweep.states, sweep.pairs, len(x)), NONE)
        out[0][sweep.inside(d) & (x > 0) & (d > x)] = 0
        return out

    return end


def diagonal_of(table: np.ndarray, d: int, x0: int, x1: int) -> np.ndarray:
    """[..., x]: the cells (x, d - x), x0 <= x <= x1, of a table [..., x, y]."""
    ly = table.shape[-1]
    step, first = max(1, ly - 1), x0 * ly + d - x0
    return table.reshape(*table.shape[:-2], -1)[..., first : first + (x1 - x0) * step + 1 : step]


def from_table(phi: np.ndarray) -> Diagonal:
    """Weights of whole tables [arc, pair, x, y]."""
    return lambda d, x0, x1: diagonal_of(phi, d, x0, x1)


def padded(arrays: list[np.ndarray], value: float) -> np.ndarray:
    """Arrays of like rank as one, the shorter ones filled up."""
    shape = np.max([a.shape for a in arrays], axis=0)
    out = np.full((len(arrays), *shape), value)
    for k, a in enumerate(arrays):
        out[(k, *map(slice, a.shape))] = a
    return out


class Models:
    """Pairs of profile models for ``dynamic.PAIR``: scores of columns by diagonal, and transitions by position.

    ``q`` and ``t`` are [position 0..L, (mm, mi, md, im, ii, dm, dd)] in log2 of each pair; ``score(d, x0, x1)`` is [pair, x]
    for matches of x and d - x, both from 1. Nothing here grows with the product of both lengths: weights
    of diagonals are kept for further sweeps in ``room`` bytes at most."""

    def __init__(self, lengths: np.ndarray, score: Diagonal, q: list[np.ndarray], t: list[np.ndarray], shift: float = SHIFT, base: float = 1.0, room: int = 0):
        self.lengths, self.score, self.shift, self.base = lengths, score, shift, base
        self.room, self.kept = room, {}
        self.ly = int(lengths[:, 1].max())

        def sides(models: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """By residue: the position itself and the one before, with nothing at residue 0 and beyond the end."""
            own = padded([m[: k + 1] for m, k in zip(models, n, strict=True)], NONE)
            before = padded([np.vstack([np.full((1, m.shape[1]), NONE), m[:k]]) for m, k in zip(models, n, strict=True)], NONE)
            return own.transpose(2, 0, 1) * base, before.transpose(2, 0, 1) * base

        (self.q, self.a), (y, b) = sides(q, lengths[:, 0]), sides(t, lengths[:, 1])
        self.t, self.b = y[:, :, ::-1], b[:, :, ::-1]  # so that y = d - x runs forward
        self.closed: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        least = np.minimum(60, (0.333 * lengths.min(1)).astype(int) + 1)
        self.least, self.lq, self.lt = least[:, None], lengths[:, :1], lengths[:, 1:]

    def close(self, paths: list[Path], reach: int = 2) -> None:
        """No further path of a pair enters a cell of its path in ``paths`` or one up to ``reach`` beside it."""
        pair = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
        xy, k = np.array([z[1:] for p in paths for z in p], int).reshape(-1, 1, 2), np.arange(-reach, reach + 1)
        beside = (xy + np.concatenate([np.stack([k, 0 * k], 1), np.stack([0 * k, k], 1)])).reshape(-1, 2)
        pair, fits = np.repeat(pair, 2 * len(k)), (beside > 0).all(1)
        order = np.argsort(beside[fits].sum(1), kind="stable")
        pair, x, d = pair[fits][order], beside[fits, 0][order], beside[fits].sum(1)[order]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        for a, z in zip(first, [*first[1:], len(d)], strict=True):
            self.closed.setdefault(int(d[a]), []).append((pair[a:z], x[a:z]))

    def matched(self, d: int, x0: int, x1: int) -> np.ndarray:
        """[pair, x]: the shifted scores of cells that leave the least overlap."""
        out = np.full((len(self.lengths), x1 - x0 + 1), NONE)
        a, z = max(1, x0), min(x1, d - 1)
        if a <= z:
            x = np.arange(a, z + 1)
            y = d - x
            open_ = ((x >= self.least) | (y <= x - self.least + self.lt)) & ((x <= self.lq - self.least) | (y >= x + self.least - self.lq))
            open_ &= (x <= self.lq) & (y <= self.lt)
            out[:, a - x0 : z - x0 + 1] = np.where(open_, (self.score(d, a, z) + self.shift) * self.base, NONE)
        return out

    def __call__(self, d: int, x0: int, x1: int) -> np.ndarray:
        if d in self.kept:
            return self._without_closed(self.kept[d].copy(order="K") if d in self.closed else self.kept[d], d, x0, x1)
        out = self._open(d, x0, x1)
        if self.room:
            out = np.ascontiguousarray(out.transpose(0, 2, 1)).transpose(0, 2, 1)  # as ``Sweep.across``
        if out.nbytes <= self.room:
            self.room -= out.nbytes
            self.kept[d] = out
            out = out.copy(order="K") if d in self.closed else out
        return self._without_closed(out, d, x0, x1)

    def _open(self, d: int, x0: int, x1: int) -> np.ndarray:
        """Weights before any cell is closed."""
        mm, mi, md, im, ii, dm, dd = range(7)
        along, back = slice(x0, x1 + 1), slice(self.ly - d + x0, self.ly - d + x1 + 1)
        q, a, t, b = self.q[:, :, along], self.a[:, :, along], self.t[:, :, back], self.b[:, :, back]
        match, out = self.matched(d, x0, x1), np.empty((13, len(self.lengths), x1 - x0 + 1))
        for m, (u, v) in enumerate(((mm, mm), (mm, dm), (im, mm), (dm, mm), (mm, im))):
            out[m] = match + a[u] + b[v]
        out[5], out[6] = b[dd], b[md]
        out[7], out[8] = q[ii] + b[mm], q[mi] + b[mm]
        out[9], out[10] = a[dd], a[md]
        out[11], out[12] = a[mm] + t[ii], a[mm] + t[mi]
        return out

    def _without_closed(self, out: np.ndarray, d: int, x0: int, x1: int) -> np.ndarray:
        for pair, x in self.closed.get(d, ()):
            here = (x >= x0) & (x <= x1)
            out[:, pair[here], x[here] - x0] = NONE
        return out

    def started(self, d: int, x0: int, x1: int) -> np.ndarray:
        """Local paths begin in any match that is allowed, whatever came before."""
        out = np.full((5, len(self.lengths), x1 - x0 + 1), NONE)
        out[0] = self.matched(d, x0, x1)
        return out


def most_accurate(sweep: Sweep, posteriors: Callable[[], Iterator[tuple[int, np.ndarray]]], least: float = LEAST_POSTERIOR) -> tuple[np.ndarray, list[Path], np.ndarray]:
    """Of each pair, the largest sum of (posterior - least) on a local path, a gap costing half of that; the path; and the
    sum of all posteriors of matches.

    Posteriors come from the last diagonal to the first, so each cell holds the best path that begins there, and its first
    move: one byte a cell."""
    pairs, lx, ly = sweep.pairs, sweep.lx, sweep.ly
    best, at, total = np.zeros(pairs), np.full((pairs, 2), -1), np.zeros(pairs)
    move = np.zeros((lx + ly + 1, pairs, lx + 2), np.int8) if sweep.block == sweep.count else {}
    one, two = np.zeros((pairs, lx + 3)), np.zeros((pairs, lx + 3))  # what begins on the next diagonal and the one behind
    for d, post in posteriors():
        x0, x1 = sweep.span(d)
        a, z = max(1, x0), min(x1, d - 1)
        new, moves = np.zeros((pairs, lx + 3)), np.zeros((pairs, lx + 2), np.int8)
        if a <= z:
            here = slice(a + 1, z + 2)
            p = np.nan_to_num(post[0][:, here])
            inside = sweep.inside(d)[:, a - x0 : z - x0 + 1]
            total += np.where(inside, p, 0).sum(1)
            # Stop after the match, go on to the next match, or skip a residue of x or of y.
            options = np.stack([p - least, p - least + two[:, a + 2 : z + 3], one[:, a + 2 : z + 3] - least / 2, one[:, a + 1 : z + 2] - least / 2])
            k = options.argmax(0)
            value = np.where(inside, options.max(0), 0)
            new[:, here], moves[:, here] = value, np.where(inside, k, 0)
            top = value.max(1)
            for b in np.flatnonzero(top > best):
                best[b], at[b] = top[b], (a + int(value[b].argmax()), 0)
                at[b, 1] = d - at[b, 0]
        move[d] = moves
        one, two = new, one
    paths: list[Path] = []
    for b in range(pairs):
        x, y = map(int, at[b])
        path: Path = []
        while x > 0 and y > 0 and x + y < sweep.count:
            k = int(move[x + y][b, x + 1])
            path.append((0, x, y) if k < 2 else (1, x, y - 1) if k == 2 else (2, x - 1, y))
            if k == 0:
                break
            x, y = x + (k != 3), y + (k != 2)
        paths.append(path)
    return best, paths, total


def column_scores(p: list[np.ndarray], s: list[np.ndarray]) -> Diagonal:
    """log2 of the products of columns, where ``s`` are divided by the background: [pair, x] for x and d - x, from 1."""
    a, b = padded(p, 0.0), padded(s, 0.0)[:, ::-1]
    ly = b.shape[1]

    def score(d: int, x0: int, x1: int) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log2(np.einsum("bxk,bxk->bx", a[:, x0 - 1 : x1], b[:, ly - d + x0 : ly - d + x1 + 1]))

    return score


@dataclass
class ModelAlignment:
    """Of one pair: best local path and its score in log2, log2 of the sum over all local paths, the sum of the posteriors of
    matches, and the path of largest expected accuracy with its gain."""

    score: float
    path: Path
    total: float
    posterior: float
    gain: float
    accurate: Path


def align_models(p: list[np.ndarray], s: list[np.ndarray], q: list[np.ndarray], t: list[np.ndarray], shift: float = SHIFT, room: int = ROOM) -> list[ModelAlignment]:
    """Batch of model pairs: columns ``p`` [x, symbol], columns over background ``s`` [y, symbol], transitions by position.

    Pairs with an empty side have no path, a score and gain of 0, and a total of 0."""
    full = [k for k in range(len(p)) if len(p[k]) and len(s[k])]
    out = [ModelAlignment(0.0, [], 0.0, 0.0, 0.0, []) for _ in p]
    if not full:
        return out
    p, s, q, t = ([z[k] for k in full] for z in (p, s, q, t))
    lengths, score = np.array([(len(a), len(b)) for a, b in zip(p, s, strict=True)]), column_scores(p, s)
    value, paths = Sweep(PAIR, lengths, Models(lengths, score, q, t, shift), room).best("local")
    natural = Models(lengths, score, q, t, shift, math.log(2))
    sweep = Sweep(PAIR, lengths, natural, room)
    forward = sweep.forward(natural.started)
    total = np.logaddexp(0, forward.matched)
    gain, accurate, posterior = most_accurate(sweep, lambda: forward.posterior(in_matches(sweep), total))
    for b, k in enumerate(full):
        out[k] = ModelAlignment(float(value[b]), paths[b], float(total[b] / math.log(2)), float(posterior[b]), float(gain[b]), accurate[b])
    return out


def alternatives(p: list[np.ndarray], s: list[np.ndarray], q: list[np.ndarray], t: list[np.ndarray], most: int, mode: str | tuple[str, ...] = "local", shift: float = SHIFT, room: int = ROOM) -> list:
    """Up to ``most`` paths of each model pair, the best first, each away from the cells beside those before it.

    Pairs with an empty side have none, and local paths end where no score above 0 is left. Of several modes, a list of such
    lists; they share the weights."""
    if not isinstance(mode, str):
        return _alternatives(p, s, q, t, most, mode, shift, room)
    return _alternatives(p, s, q, t, most, (mode,), shift, room)[0]


def _alternatives(p: list[np.ndarray], s: list[np.ndarray], q: list[np.ndarray], t: list[np.ndarray], most: int, modes: tuple[str, ...], shift: float, room: int) -> list[list[list[tuple[float, Path]]]]:
    out: list[list[list[tuple[float, Path]]]] = [[[] for _ in p] for _ in modes]
    full = [k for k in range(len(p)) if len(p[k]) and len(s[k])]
    if not full:
        return out
    p, s, q, t = ([z[k] for k in full] for z in (p, s, q, t))
    lengths = np.array([(len(a), len(b)) for a, b in zip(p, s, strict=True)])
    models = Models(lengths, column_scores(p, s), q, t, shift, room=room)
    for mode, found in zip(modes, out, strict=True):
        models.closed.clear()
        for _ in range(most):
            value, paths = Sweep(PAIR, lengths, models, room).best(mode)
            for b, path in enumerate(paths):
                if path:
                    found[full[b]].append((float(value[b]), path))
            if not any(paths):
                break
            models.close(paths)
    return out


#: Fixed value: how near two residues of a chain must be to follow each other in a path of largest accuracy.
ACCURACY_RADIUS = 7.0


def accurate_under_chain(post: list[np.ndarray], follows: list[np.ndarray], at: list[np.ndarray], radius: float = ACCURACY_RADIUS, room: int = ROOM) -> tuple[np.ndarray, list[Path]]:
    """Of each pair the local path of largest sum of posteriors [x, y] of its matches, gaps being free, that the chain of the
    x side allows, and that sum. A cell keeps one path to each state, with the last match on it."""
    lengths = np.array([z.shape for z in post])
    table = padded([np.pad(z, ((1, 0), (1, 0))) for z in post], 0.0)

    def weights(d: int, x0: int, x1: int) -> np.ndarray:
        out, x = np.zeros((len(THREE.arcs), len(post), x1 - x0 + 1)), np.arange(x0, x1 + 1)
        out[[0, 3, 6]] = np.ascontiguousarray(diagonal_of(table, d, x0, x1))
        out[:, (x > lengths[:, :1]) | (d - x > lengths[:, 1:])] = NONE
        return out

    chain = Geometry(padded([np.asarray(f, bool) for f in follows], False).astype(bool), padded(at, np.nan), radius)
    return Sweep(THREE, lengths, weights, room).best("local", chain)


def in_batches(pairs: DataFrame, kernel: Callable[..., list[dict]], columns: list[str], sizes: tuple[Column, Column], schema: str, states: int = 5, most: int = 64, room: int = ROOM) -> DataFrame:
    """``kernel(lists of the columns of some pairs)``, a dict for each pair; keeps pair_id.

    Pairs are dealt to all tasks by a hash, as their work is quadratic in their lengths, and sorted by ``sizes`` in a task, so
    that those of like length go together: at most ``most``, and as many as keep all diagonals in ``room``."""
    kind, names = dict(pairs.dtypes)["pair_id"], [c.split(" ")[0] for c in schema.split(", ")]
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select("pair_id", *columns, *[F.coalesce(z, F.lit(0)).cast("long").alias(f"size{k}") for k, z in enumerate(sizes)])
    # By a hash of the id: a partitioning by the id itself may be there already, for fewer tasks.
    rows = rows.repartition(tasks, F.xxhash64("pair_id")).sortWithinPartitions("size0", "size1")

    def done(batch: list[tuple]) -> pd.DataFrame:
        found = kernel(*zip(*[row[1:-2] for row in batch], strict=True))
        return pd.DataFrame([{"pair_id": row[0], **z} for row, z in zip(batch, found, strict=True)], columns=["pair_id", *names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, lx, ly = [], 0, 0
        for row in (r for f in frames for r in f.itertuples(index=False, name=None)):
            x, y = max(lx, row[-2]), max(ly, row[-1])
            if batch and (len(batch) >= most or (len(batch) + 1) * states * (x + 2) * (x + y + 1) * 8 > room):
                yield done(batch)
                batch, x, y = [], row[-2], row[-1]
            batch.append(row)
            lx, ly = x, y
        if batch:
            yield done(batch)

    return rows.mapInPandas(run, f"pair_id {kind}, {schema}")
