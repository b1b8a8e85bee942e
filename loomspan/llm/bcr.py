"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many short strings at once.

The strings are aligned: column 0 of each is where a core begins that all its windows hold. Each round inserts one symbol of
every string, from the last column to the first, and rewrites two sequences in one pass: the order of the suffixes that
start in the column (the symbols before them, in this order, are the column's part of the transform) and the common
prefixes of neighbours. A suffix that extends another keeps its order among those that extend with the same symbol; the
common prefix with its new neighbour is one symbol more than the least in the range that the two spanned before. As equal
windows of aligned strings start in the same column, suffixes of other columns need no place in the order, so a round costs
one step a string however many columns are done. Strings leave once no window of theirs begins further ahead.

Behind and in the core, where no window starts, a symbol is eight bytes; before it, one byte. A collection is one bucket of
bounded size, so its sequences are arrays in memory and not files.
"""

from __future__ import annotations

import numpy as np

#: What a string has beyond its ends: a byte that UTF-8 never holds.
NOTHING = 255
GAP = 16
WORD = 8


def _same_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two arrays of different eight-byte numbers share."""
    x = a ^ b
    out = np.zeros(len(x), np.int16)
    for k in range(1, WORD):
        out += x < np.uint64(1 << (64 - 8 * k))
    return out


class _Order:
    """The strings by their suffixes from the last column inserted, and the bytes each shares with the one before."""

    def __init__(self, n: int, most: int):
        self.ids, self.most = np.arange(n, dtype=np.int32), most
        self.prefix = np.zeros(n + 1, np.int16)  # the last one is a stop

    def insert(self, own: np.ndarray, weight: int) -> None:
        """Puts ``own`` (a symbol for each string, in the present order) before the suffixes."""
        turn = np.argsort(own, kind="stable")
        self.ids, own = self.ids[turn], own[turn]
        same, last = own[1:] == own[:-1], self.prefix[turn[1:]]
        # Most neighbours were neighbours before; only between others something lies that may share less.
        apart = np.flatnonzero(same & (turn[1:] - turn[:-1] > 1))
        if len(apart):
            some = (last[apart] > 0) & (self.prefix[turn[apart] + 1] > 0)
            last[apart[~some]] = 0
            apart = apart[some]
        if len(apart):
            ranges = np.empty(2 * len(apart), np.int64)
            ranges[::2], ranges[1::2] = turn[apart] + 1, turn[apart + 1] + 1
            last[apart] = np.minimum.reduceat(self.prefix, ranges)[::2]
        last += weight
        np.minimum(last, self.most, out=last)
        last *= same
        if weight > 1:
            other = np.flatnonzero(~same)
            last[other] = _same_bytes(own[other], own[other + 1])
        self.prefix[1 : len(own)] = last

    def leave(self, stay: np.ndarray) -> None:
        kept = np.flatnonzero(stay)
        self.ids = self.ids[kept]
        if len(kept):
            least = np.minimum.reduceat(self.prefix[:-1], np.append(0, kept[:-1] + 1))
            if kept[-1] + 1 < len(stay):  # the last range must not reach beyond its string
                least[-1] = self.prefix[(kept[-2] + 1 if len(kept) > 1 else 0) : kept[-1] + 1].min()
            self.prefix = np.append(least, np.int16(0))


def shared_windows(strings: list[bytes], left: np.ndarray, count: np.ndarray, length: int, core: int) -> np.ndarray:
    """(string, window, n): runs of windows, ``n`` from ``window`` on, whose ``length`` bytes start in the same column of two strings.

    String i has windows at its first ``count[i]`` bytes and its core, which is ``core`` bytes long and in all of them,
    ``left[i]`` bytes from its start."""
    n = len(strings)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    gap = bytes([NOTHING]) * GAP
    joined = gap.join([b"", *strings, gap])
    raw = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    start = np.cumsum(sizes + GAP) - sizes
    at = start + left
    words = np.ndarray((len(raw) - WORD + 1,), ">u8", joined, 0, (1,))
    order = _Order(n, length)
    # Whole words from the core on, up to the last window's end, the last first.
    for k in range((length - 1) // WORD, -1, -1):
        have = np.clip(sizes - left - k * WORD, 0, WORD)[order.ids]
        symbol = words[np.minimum(at[order.ids] + k * WORD, len(words) - 1)].astype(np.uint64)
        beyond = np.where(have > 0, np.uint64(2**64 - 1) >> (8 * np.maximum(have, 1) - 1).astype(np.uint64) >> np.uint64(1), np.uint64(2**64 - 1))
        order.insert(symbol | beyond, WORD)
    hit = np.zeros((n, length - core + 2), bool)  # by the distance of the window's start from the core
    for k in range(int(left.max()) + 1):
        if k:
            if (k - 1) % GAP == 0:
                order.leave(left[order.ids] >= k)
                if len(order.ids) < 2:
                    break
            order.insert(raw[at[order.ids] - k], 1)
        near = order.prefix >= length
        hit[order.ids[near[:-1] | near[1:]], k] = True
    distance = np.arange(hit.shape[1])[None, :]
    hit &= (distance <= left[:, None]) & (distance > (left - count)[:, None])
    flat = np.flatnonzero(np.diff(hit.ravel().view(np.int8), prepend=np.int8(0)))  # the last column is empty
    first, stop = flat[::2], flat[1::2]
    which = first // hit.shape[1]
    return np.stack([which, left[which] - (stop - 1) % hit.shape[1], stop - first], 1)
