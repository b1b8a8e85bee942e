"""Removal of byte strings that repeat anywhere in the corpus, by column-wise construction of suffix orders.

Every start of a ``length``-byte string (a window) is dealt by a content key: of the places in it where a core of ``core``
bytes fits, the first with the least hash of eight bytes begins its core, and the core's hash is the key. Equal windows have
equal cores at equal distances, so no match is lost, and the windows of one core travel as one segment. Keys that occur once
can't repeat and are dropped. The segments of the others are cut out of the texts and dealt by key to buckets of bounded
size, where the column-wise construction of the Burrows-Wheeler transform and common prefixes (``bcr``) inserts one symbol of
every segment a round, aligned by their cores, and decides on every window by the bytes it shares with its neighbours. Hashes
deal the work only.

A key whose segments exceed a bucket (a very frequent passage) is not gathered in one task: it is dealt to salted parts, each
decided like a bucket, and one segment of each kind of equal bytes goes on to meet those of the other parts. There kinds that
occur in several parts are covered as a whole, and one of each is dealt again by the next longer core. The last core is a
whole window, so that equal bytes decide all that is left.

Strings are judged on the input, overlaps count, and matches never cross documents. Texts are shuffled twice by document,
to cut segments out and to remove what is covered. What a phase staged or shuffled is dropped before the next one.

Defined results: a null text counts as empty; a text shorter than ``length`` has no window. Rows that repeat id and text are
different places, so both lose their windows. Rows that share an id but not the text are told apart by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.bcr import shared_windows
from loomspan.llm.common import drop, staged, table
from loomspan.llm.wordhash import buffers, mix, slices

LENGTH = 200
CORES = (64, 160, 200)
BUCKET_BYTES = 2 << 20
PIECE = 1 << 15
TEXT_BYTES = 1 << 22
_ORDER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_PLACE = np.uint64(0xFFFF)
_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    if (base, size) not in _TABLES:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _TABLES[base, size] = np.multiply.accumulate(p)
    return _TABLES[base, size]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of every ``w`` consecutive values, by doubling."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[:n], x[w - size : w - size + n]) if size < w else x


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # row, key, start in the row, windows, bytes before the core


def _segments(raw: np.ndarray, off: np.ndarray, length: int, core: int) -> Iterator[Found]:
    """The segments of all rows that ``off`` cuts ``raw`` into, a bounded number of bytes at a time."""
    w, size = length - core + 1, PIECE + length
    gram = min(8, core)
    for i, j in slices(off, PIECE):
        for a in range(int(off[i]), int(off[j]) - length + 1, PIECE):
            part = raw[a : min(a + PIECE + length - 1, int(off[j]))]
            n = len(part)
            # The order of places by a hash of the bytes there; the low bits hold the place itself, so the first least one wins.
            word = np.ndarray((n,), "<u8", part.tobytes() + bytes(8), 0, (1,)) << np.uint64(64 - 8 * gram)
            rank = ((word * _ORDER) & ~_PLACE)[: n - core + 1]
            rank |= np.arange(len(rank), dtype=np.uint64)
            at = (_sliding_min(rank, w) & _PLACE).astype(np.int64)
            inside = np.ones(len(at), bool)  # windows that don't reach into the next row
            for end in (off[i + 1 : j + 1] - a).tolist():
                inside[max(0, end - length + 1) : max(0, end)] = False
            new = np.flatnonzero((at[1:] != at[:-1]) | (inside[1:] != inside[:-1])) + 1
            s, e = np.append(0, new), np.append(new, len(at))
            s, e = s[inside[s]], e[inside[s]]
            if not len(s):
                continue
            at = at[s]
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[:n], out=total[1:])
            key = mix((total[at + core] - total[at]) * _powers(pow(_BASE, -1, 2**64), size)[at])
            row = np.searchsorted(off, s + a, "right") - 1
            yield row, key, s + a - off[row], e - s, at - s


def _columns(found: Iterator[Found], batch: pa.RecordBatch, base: np.ndarray | None = None) -> Iterator[tuple[list[pa.Array], Found]]:
    for row, m, s, c, before in found:
        at = pa.array(row)
        start = s if base is None else base[row] + s
        yield [pa.array(m.view(np.int64)), batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(start.astype(np.int64)), pa.array(c.astype(np.int32)), pa.array(before.astype(np.int32))], (row, m, s, c, before)


SEGMENT = "m long, doc_id long, th long, start long, cnt int, ahead int"
NAMES = [x.split()[0] for x in SEGMENT.split(", ")]
CUT = f"{SEGMENT}, salts int, text binary"
AGAIN = f"{SEGMENT}, text binary"


def _reader(length: int, core: int):
    """The places of the segments of texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, _ in _columns(_segments(*buffers(batch.column("text")), length, core), batch):
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return read


def _again(length: int, core: int):
    """The segments, with their bytes, of strings that were cut out of texts at ``start``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            text = raw.tobytes()
            for columns, (row, _, s, c, _) in _columns(_segments(raw, off, length, core), batch, batch.column("start").to_numpy()):
                a = off[row] + s
                parts = [text[x:y] for x, y in zip(a.tolist(), (a + c + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names=[*NAMES, "text"])

    return read


def _cutter(length: int):
    """Cut the wanted segments out of the texts, a bounded number of bytes and of segments at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            wanted = batch.column("wanted")
            ends = np.append(0, np.cumsum(wanted.value_lengths().to_numpy()))
            flat = wanted.flatten()
            start, cnt = flat.field("start").to_numpy(), flat.field("cnt").to_numpy()
            for i, j in slices(off, TEXT_BYTES):
                text = raw[off[i] : off[j]].tobytes()
                row = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
                for k in range(0, len(row), PIECE):
                    at, rows = ends[i] + k, row[k : k + PIECE]
                    a = off[rows] - off[i] + start[at : at + len(rows)]
                    parts = [text[x:y] for x, y in zip(a.tolist(), (a + cnt[at : at + len(rows)] + length - 1).tolist(), strict=True)]
                    piece, rows = flat.slice(at, len(rows)), pa.array(rows)
                    columns = [piece.field("m"), batch.column("doc_id").take(rows), batch.column("th").take(rows), *(piece.field(c) for c in ("start", "cnt", "ahead", "salts")), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*NAMES, "salts", "text"])

    return cut


SPAN = "doc_id long, th long, start long, stop long"
PART = f"{SPAN}, m long, text binary, n long"


def _bucket(length: int, core: int):
    def search(rows: pa.Table) -> pa.Table:
        """Covered spans of the segments of one bucket; then, if it is a part of a frequent key, one segment of each kind
        with its bytes and the number of its copies, n > 0."""
        rows = rows.combine_chunks()
        text, start = rows["text"].to_pylist(), rows["start"].to_numpy()
        found = shared_windows(text, rows["ahead"].to_numpy(), rows["cnt"].to_numpy(), length, core)
        kinds: dict[bytes, list[int]] = {}
        if rows["salts"][0].as_py() > 1:
            for i, x in enumerate(text):
                kinds.setdefault(x, []).append(i)
        first = np.array([k[0] for k in kinds.values()], np.int64)
        at = np.append(found[:, 0], first)
        begin = np.append(start[found[:, 0]] + found[:, 1], start[first])
        windows = np.append(found[:, 2], rows["cnt"].to_numpy()[first])
        columns = [rows["doc_id"].take(pa.array(at)), rows["th"].take(pa.array(at)), pa.array(begin), pa.array(begin + windows + length - 1), rows["m"].take(pa.array(at))]
        columns += [pa.array([None] * len(found) + list(kinds), pa.binary()), pa.array([0] * len(found) + [len(k) for k in kinds.values()], pa.int64())]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in PART.split(", ")])

    return search


def _decided(segments: DataFrame, total: int, length: int, core: int, bucket_bytes: int) -> DataFrame:
    """Staged spans and kinds of ``segments`` (with ``salts``, the parts that their key is dealt to), bucket by bucket: the
    segments of several keys, or a part of one frequent key."""
    buckets = max(1, -(-total // bucket_bytes))
    part = F.pmod(F.xxhash64("doc_id", "th", "start"), F.col("salts"))
    bucket = F.when(F.col("salts") == 1, F.pmod(F.xxhash64("m"), F.lit(buckets))).otherwise(-1 - F.pmod(F.xxhash64("m", part), F.lit(2**62)))
    dealt = segments.select("m", "doc_id", "th", "start", "cnt", "ahead", "salts", "text", bucket.alias("bucket"))
    return staged(dealt.groupBy("bucket").applyInArrow(_bucket(length, core), PART), "zstd")


def _across(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged, of the kinds that the parts of frequent keys left: spans of those that one part has once and others have as
    well, and one segment of each kind. A kind has at most as many rows as its key has parts."""
    kind = ["m", "text"]
    some = parts.where("n > 0")
    kinds = staged(some.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "th", "start")).alias("at")), "zstd")
    spans = staged(some.where("n = 1").join(kinds.where("n > 1").select(*kind), kind).select("doc_id", "th", "start", "stop"))
    rest = staged(kinds.select("at.doc_id", "at.th", "at.start", "text"), "zstd")
    drop(parts.sparkSession, kinds)
    return spans, rest


def _places(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def _keys(segments: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """m and salts (parts of at most a bucket's bytes) of every key that occurs more than once."""
    sized = segments.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.col("cnt") + F.lit(length - 1)).alias("bytes")).where("n > 1")
    return sized.select("m", "bytes", F.ceil(F.col("bytes") / bucket_bytes).cast("int").alias("salts"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, cores: tuple[int, ...] = CORES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, th (hash of the text), start, stop: spans that cover every byte in a string of ``length`` bytes that starts at
    two places."""
    spark = docs.sparkSession
    texts = _places(docs)
    segments = staged(texts.mapInArrow(_reader(length, cores[0]), SEGMENT))
    keys = staged(_keys(segments, length, bucket_bytes))
    repeated = staged(segments.join(keys.select("m", "salts"), "m"))
    drop(spark, segments)
    place = F.struct("m", "start", "cnt", "ahead", "salts")
    wanted = repeated.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set(place).alias("wanted"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    # The segments of a text overlap, so that those of one text compress well next to each other.
    cut = staged(texts.join(wanted, same).select("doc_id", "th", "text", "wanted").mapInArrow(_cutter(length), CUT), "zstd")
    drop(spark, repeated)
    spans: list[DataFrame] = []
    for level, core in enumerate(cores):
        total, most = keys.agg(F.sum(F.when(F.col("salts") == 1, F.col("bytes"))), F.max("salts")).first()
        if most is None:
            break
        parts = _decided(cut, total or 0, length, core, bucket_bytes)
        drop(spark, cut, keys)
        spans.append(parts.where("n = 0").select("doc_id", "th", "start", "stop"))
        if most == 1:
            break
        covered, kinds = _across(parts)
        spans.append(covered)
        if level + 1 < len(cores):
            segments = staged(kinds.mapInArrow(_again(length, cores[level + 1]), AGAIN), "zstd")
            keys = staged(_keys(segments, length, bucket_bytes))
            cut = staged(segments.join(keys.select("m", "salts"), "m"), "zstd")
            drop(spark, segments, kinds)
    drop(spark, cut, keys)
    if not spans:
        return spark.createDataFrame([], SPAN)
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def _remover(texts: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            spans = batch.column("spans")
            for i, j in slices(off, TEXT_BYTES):
                rows, kept = [], []
                for k in range(i, j):
                    part = raw[off[k] : off[k + 1]]
                    n_removed = n_spans = 0
                    if spans[k].is_valid:
                        at = spans[k].values
                        step = np.zeros(len(part) + 1, np.int64)
                        np.add.at(step, at.field("start").to_numpy(), 1)
                        np.add.at(step, at.field("stop").to_numpy(), -1)
                        gone = np.cumsum(step)[:-1] > 0
                        n_removed = int(gone.sum())
                        n_spans = int((gone & ~np.append(False, gone[:-1])).sum())
                        part = part[~gone]
                    rest = part.tobytes()
                    if texts:
                        kept.append(rest)
                    rows.append((int(off[k + 1] - off[k]), n_removed, n_spans, hashlib.sha256(rest).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                columns += [pa.array(kept, pa.binary())] if texts else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(columns)])

    return remove


def remove_repeats(docs: DataFrame, texts: bool = True, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``, with the kept bytes if ``texts``."""
    spans = repeated_spans(docs, **options).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    rows = _places(docs).join(spans, same, "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(_remover(texts), f"{schema}, kept binary" if texts else schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
