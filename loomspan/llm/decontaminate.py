"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of the benchmark items (an item of fewer words is one window). For
each pattern length a shift table over blocks of two words tells how far a search may jump; where it says zero, the
bucket of the last block's hash, in which patterns are ordered by a hash of all their words, selects patterns, and the words
themselves are compared. A task searches many positions of its documents at once, each lane over its own span of words.

The patterns are broadcast in shards of at most ``shard_bytes`` of benchmark text, one pass over the documents for each;
between passes the table is staged, so memory is bounded however large the benchmark is. A shard keeps its text once; a
pattern is a hash and the number of its first word, about 16 bytes a word in all. No shuffle is needed.

Defined results: null or empty texts and texts without words have no words and are not contaminated; rows that repeat are
judged each for itself; an empty benchmark contaminates nothing. A null item_id is ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import free_name, staged, table
from loomspan.llm.wordhash import LOWER, buffers, combine, mix, slices, words

WINDOW = 10
SHARD_BYTES = 16 << 20
BLOCK = 2
LANE = 512


def _plain(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(LOWER[raw[s:e]].tobytes() for s, e in zip(starts, ends, strict=True))


class Patterns:
    """Shift tables and buckets of the windows of some items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = [item for item, _ in items]
        raw, off = buffers(pa.array([text for _, text in items], pa.large_string()))
        starts, ends, hashes = words(raw, off)
        self.first = np.searchsorted(starts, off).astype(np.int64)  # of each item's words
        place = np.cumsum(ends - starts + 1, dtype=np.int64)
        self.place = np.append(0, place).astype(np.uint32 if len(place) and place[-1] < 2**32 else np.int64)
        # All words, lower-cased, each with a space behind it.
        self.text = b"".join(_plain(raw, starts[a:b], ends[a:b]) + b" " for a, b in zip(self.first, self.first[1:], strict=False) if a < b)
        n = np.diff(self.first)
        self.tables = {}
        for length in sorted(set(np.minimum(n[n > 0], window).tolist())):
            of = np.flatnonzero(n == length) if length < window else np.flatnonzero(n >= window)
            begins = np.zeros(len(starts) + 1, np.int32)  # words at which a window of this length may begin
            np.add.at(begins, self.first[of], 1)
            np.add.at(begins, self.first[of] + n[of] - length + 1, -1)
            at = np.flatnonzero(np.cumsum(begins) > 0)
            block = min(BLOCK, length)
            bits = int(min(22, max(12, np.ceil(np.log2(len(at) * length + 1)) + 4)))
            shift = np.full(1 << bits, length - block + 1, np.uint8 if length < 250 else np.int64)
            for j in range(block - 1, length):
                np.minimum.at(shift, self.block(hashes[at + j - 1] if block > 1 else None, hashes[at + j], bits), length - 1 - j)
            key = self.key(hashes, at, length, block, bits)
            order = np.argsort(key)
            self.tables[length] = (shift, bits, block, key[order], at[order].astype(np.uint32))

    def key(self, hashes: np.ndarray, at: np.ndarray, length: int, block: int, bits: int) -> np.ndarray:
        """The bucket of the last block, then a hash of all words."""
        end = at + length - 1
        bucket = self.block(hashes[end - 1] if block > 1 else None, hashes[end], bits).astype(np.uint64)
        return bucket << np.uint64(64 - bits) | combine(hashes, at, length) >> np.uint64(bits)

    def words(self, at: int, length: int) -> bytes:
        return self.text[int(self.place[at]) : int(self.place[at + length]) - 1]

    @staticmethod
    def block(one: np.ndarray | None, two: np.ndarray, bits: int) -> np.ndarray:
        h = two if one is None else one * np.uint64(0xC2B2AE3D27D4EB4F) + two
        return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)

    def search(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """First word of each row (n + 1), hit flags of all words, and the items found by row."""
        starts, ends, hashes = words(raw, off)
        first = np.searchsorted(starts, off)
        hit, found = np.zeros(len(starts), bool), defaultdict(set)
        for length, (shift, bits, block, keys, where) in self.tables.items():
            lo, hi = first[:-1] + length - 1, first[1:]
            n = np.maximum(0, -(-(hi - lo) // LANE))
            at = np.repeat(lo, n) + LANE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            stop = np.minimum(at + LANE, np.repeat(hi, n))
            places = []
            while len(at):
                jump = shift[self.block(hashes[at - 1] if block > 1 else None, hashes[at], bits)].astype(np.int64)
                places.append(at[jump == 0] - length + 1)
                at = at + np.maximum(jump, 1)
                on = at < stop
                at, stop = at[on], stop[on]
            at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
            key = self.key(hashes, at, length, block, bits)
            bucket = np.searchsorted(keys, key)
            maybe = keys[np.minimum(bucket, len(keys) - 1)] == key
            for p, k, own in zip(at[maybe], bucket[maybe], key[maybe], strict=True):
                text = _plain(raw, starts[p : p + length], ends[p : p + length])
                while k < len(keys) and keys[k] == own:
                    if self.words(where[k], length) == text:
                        hit[p : p + length] = True
                        found[int(np.searchsorted(first, p, "right")) - 1].add(self.items[int(np.searchsorted(self.first, where[k], "right")) - 1])
                    k += 1
        return first, hit, found


def _scanner(broadcast):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = broadcast.value
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j in slices(off):
                part = batch.slice(i, j - i)
                first, hit, found = patterns.search(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                old_hits, old_items = part.column("hits"), part.column("items")
                hits, items = [], []
                at = np.flatnonzero(hit)
                cut = np.searchsorted(at, first)
                for r in range(j - i):
                    more = at[cut[r] : cut[r + 1]] - first[r] if cut[r] < cut[r + 1] else ()
                    had = old_hits[r].as_py() if old_hits[r].is_valid else []
                    hits.append(sorted({*had, *map(int, more)}) if had else [int(x) for x in more])
                    items.append(sorted({*(old_items[r].as_py() or [])} | found.get(r, set())) if r in found or had else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(np.diff(first), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "hits", "items"],
                )

    return scan


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text, n_words, hits (indexes of hit words), items (ids as strings) of every row of ``docs``."""
    spark = docs.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    rows = docs.select("doc_id", "text").selectExpr("doc_id", "text", "0L AS n_words", "CAST(NULL AS array<int>) AS hits", "CAST(NULL AS array<string>) AS items")
    for k in range(shards):
        # At most about shard_bytes of text reach the driver here.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect() if shards > 1 else items.collect()
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(Patterns([tuple(x) for x in part], window))), rows.schema)
        if k < shards - 1:
            rows = staged(rows)
    return rows


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    none = free_name(docs, "__none")
    rest = F.struct(F.lit(0).alias(none), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = matches(docs.select(rest.alias("doc_id"), "text"), benchmark, window).where(F.size("hits") == 0)
    return found.select(*[F.col("text") if c == "text" else F.col(f"doc_id.`{c}`") for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH tr AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, tr),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, tr),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS w
      FROM b, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
       FROM d, lens, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i) WHERE len(ws) >= n),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN p ON dw.w = p.w AND dw.n = p.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS js
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(js, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
