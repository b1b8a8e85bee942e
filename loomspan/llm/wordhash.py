"""Words of whole Arrow text columns as NumPy arrays: boundaries and 64-bit hashes, without a Python loop over words.

A word is a run of bytes that are an ASCII letter or digit (A-Z lower-cased) or lie beyond ASCII; in UTF-8 this is the
pattern ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 2**64)
PIECE = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for r in (_R, _R_INV):
            p = np.full(PIECE, r, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes (UTF-8 of strings) of a column and the rows' n + 1 offsets in them; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, hashes of the words of the rows that ``off`` cuts ``raw`` into; no word crosses rows."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    on = IS_WORD[LOWER[raw]]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = on[:-1]
    starts = np.flatnonzero(on & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = on[1:]
    ends = np.flatnonzero(on & (~after | edge[1:])) + 1
    hashes = np.zeros(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(starts):  # pieces that end with a word's end
        base = starts[i]
        j = int(np.searchsorted(ends, base + PIECE, "right"))
        if j <= i:  # one word longer than a piece
            hashes[i] = _long(raw[base : ends[i]])
            i += 1
            continue
        piece = LOWER[raw[base : ends[j - 1]]].astype(np.uint64)
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum((piece + np.uint64(1)) * up[: len(piece)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = mix((total[e] - total[s]) * down[s])
        i = j
    return starts, ends, hashes


def _long(raw: np.ndarray) -> np.uint64:
    up, _ = _powers()
    h, scale = 0, 1
    for k in range(0, len(raw), PIECE):
        part = LOWER[raw[k : k + PIECE]].astype(np.uint64) + np.uint64(1)
        h = (h + scale * int((part * up[: len(part)]).sum(dtype=np.uint64))) % 2**64
        scale = scale * int(pow(_R, len(part), 2**64)) % 2**64
    return mix(np.array([h], np.uint64))[0]


def slices(off: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, at least one row each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def combine(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words that begin at each index of ``at``."""
    h = np.zeros(len(at), np.uint64)
    for k in range(length):
        h = (h ^ hashes[at + k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    return h
