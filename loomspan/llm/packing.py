"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and, for the rest, into pieces of at most ``piece`` ids; only the pieces'
places, lengths and checksums are shuffled. The rests are dealt by a hash into groups that hold about ``windows`` windows
in expectation, however large the corpus. In a group, differencing starts with one partial partition for each piece (that
piece in one window, the others empty) and merges the two partial partitions of largest imbalance, the largest window of
one with the smallest of the other, until one partition is left. If a window then holds more than the capacity, the
number of windows rises by one and the group is partitioned anew.

Defined results: a null or empty text has just the end id; rows that repeat are packed each for itself. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark import TaskContext
from tokenizers import Tokenizer

from loomspan.llm.common import staged, table

CAPACITY = 2048
PIECE = 512
WINDOWS = 128
#: One text of so many is cut finely: differencing ends with its small pieces, which even out the windows.
FINE = 4
END = 1
TOKENIZER = "byte_bpe_50k.json"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

_LOADED: dict[str, tuple[Tokenizer, tiktoken.Encoding | None]] = {}


def _by_ranks(path: str) -> tiktoken.Encoding | None:
    """The byte-level BPE of a tokenizer's file as ranks, where its ids follow its merges; else None."""
    with open(path) as file:
        model = json.load(file)["model"]
    # The printable stand-ins of byte-level BPE: bytes that print stay, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(t) != 256 + i for i, t in enumerate(merged)):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merged)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers.

    Texts go through the same merges as ranks, several times faster; those with something like a special token, and those
    whose runs of white space are too long for that library's pattern matcher, through the tokenizer itself."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path), _by_ranks(path)
    tokenizer, ranks = _LOADED[path]
    for text in texts:
        ids = None
        if ranks is not None and "<|" not in text:
            try:
                ids = ranks.encode_ordinary(text)
            except BaseException as error:  # noqa: BLE001  its panics aren't exceptions
                if type(error).__name__ != "PanicException":
                    raise
        if ids is None:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
        yield array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


def rest_cuts(n: int, piece: int, fine: bool) -> list[int]:
    """Where the pieces of a rest of ``n`` ids begin: nearly equal ones, or each a quarter of what is left."""
    if not fine:
        k = -(-n // piece)
        return [n * i // k for i in range(k)]
    cuts, at = [], 0
    while at < n:
        cuts.append(at)
        at += min(piece, -(-(n - at) // 4)) if n - at > 8 else n - at
    return cuts


def _cutter(path: str, capacity: int, piece: int):
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(texts, path), strict=True):
                ids += end
                n = len(ids) // 4
                whole = n - n % capacity
                fine = zlib.crc32(ids) % FINE == 0
                cuts = [*range(0, whole, capacity), *(whole + x for x in rest_cuts(n - whole, piece, fine)), n]
                rows += [(doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n, row) for a, b in zip(cuts, cuts[1:], strict=False)]
                row += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return cut


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each item when ``k`` windows are balanced by Karmarkar-Karp differencing."""
    if k == 1:
        return np.zeros(len(sizes), int)
    window = np.zeros(len(sizes), int)
    # A partial partition: loads in descending order, and for each load the root of the items in it.
    parent = np.arange(len(sizes))
    heap = []
    for i, s in enumerate(sizes.tolist()):
        loads, roots = np.zeros(k, np.int64), np.full(k, -1)
        loads[0], roots[0] = s, i
        heap.append((-s, i, loads, roots))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        loads, rb = a + b[::-1], rb[::-1]
        both = (ra >= 0) & (rb >= 0)
        parent[rb[both]] = ra[both]
        roots = np.where(ra >= 0, ra, rb)
        order = np.argsort(-loads, kind="stable")
        loads, roots = loads[order], roots[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), count, loads - loads[-1], roots))
        count += 1
    if heap:
        window[heap[0][3][heap[0][3] >= 0]] = np.flatnonzero(heap[0][3] >= 0)
    while True:
        above = parent[parent]
        if (above == parent).all():
            break
        parent = above
    return window[parent]


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sizes = group["length"].to_numpy(np.int64)
        whole = int((sizes == capacity).sum())
        rest = sizes[whole:]
        window = np.arange(len(sizes))
        if len(rest):
            k = max(1, -(-int(rest.sum()) // capacity))
            while True:
                at = differencing(rest, k)
                if np.bincount(at, rest).max() <= capacity:
                    break
                k += 1
            window[whole:] = whole + at
        group["sequence_id"] = group["part"] * 2**32 + window
        group = group.sort_values("sequence_id", kind="stable", ignore_index=True)
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, path: str | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text): where its ids lie in which sequence."""
    path = path or public_tokenizers.path(TOKENIZER)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(path, capacity, piece), f"{schema}, row long"))
    rest = pieces.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(rest / (windows * capacity)))
    # Rows that repeat id and text spread over groups too: the table is written once, with the number of each row.
    part = F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).alias("part")
    out = f"{schema}, sequence_id long, offset long"
    return pieces.select("*", part).groupBy("part").applyInPandas(_packer(capacity), out)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
