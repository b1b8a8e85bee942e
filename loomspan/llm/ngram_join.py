"""Near-duplicate join on word n-grams by MinHash banding, verified on the full n-gram sets.

Texts with equal n-gram sets are one class of copies and only its smallest id goes on. Its MinHash signature is cut into
bands, whose number and rows are chosen for a target recall at the threshold. Candidates share a band's hash: the buckets
are aggregated before their shuffle and linked by star edges, and the connected components of these are dealt to tasks by
total size, so each text is shipped once and not once for each band. A task enumerates pairs band by band, verifies a pair
in the first band it shares, and returns counts of links and a spanning forest of them, never the pairs. A component larger
than a task is cut into blocks and each pair of blocks is a task; one with many blocks goes by bucket instead, each bucket
in blocks of its own. So no group is collected whole, and no link between different texts is lost to a cap.

A text goes by its id and a hash of it, so that different texts of one id, or of none, have classes and links of their own.

Defined results: words are those of ``wordhash``; a text of one to four words is one n-gram; null and empty texts and texts
without words are in no class but their own. Rows that share id and text are copies of each other. Null ids come after all
others; a class of null ids only has a null class_id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import drop, free_name, skewed_join, staged, table
from loomspan.llm.url_filter import components
from loomspan.llm.wordhash import buffers, combine, mix, slices, words

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 96
TASK_GRAMS = 1 << 20
MOST_BLOCKS = 8


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: as many rows as ``most`` hashes allow with bands enough for the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def gram_sets(raw: np.ndarray, off: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    starts, _, hashes = words(raw, off)
    first = np.searchsorted(starts, off)
    out = []
    all_grams = combine(hashes, np.arange(max(0, len(hashes) - size + 1)), size)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(all_grams[a : b - size + 1]))
        elif b > a:
            out.append(combine(hashes, np.array([a]), int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return k[:n, None] | np.uint64(1), k[n:, None]


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = _permutations(bands * rows)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for k in range(0, len(grams), 4096):
        x = grams[None, k : k + 4096] * a
        x += b
        np.minimum(least, x.min(1), out=least)
    least = mix(least).reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        h = mix((h + least[:, r]) * np.uint64(0x9FB21C651E98DF25))
    return h


SIGNATURE = "doc_id long, th long, s1 long, s2 long, grams long, bands array<long>"


def _signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j in slices(off):
                sets = gram_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], size)
                digests = [_set_hash(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([len(x) for x in sets], pa.int64()), pa.array([band_hashes(x, bands, rows).view(np.int64) if len(x) else None for x in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "th", "s1", "s2", "grams", "bands"],
                )

    return sign


def _set_hash(grams: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    if not len(grams):
        return None, None
    d = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


NODE = ["none", "id", "th"]
LINKS = "a_none boolean, a_id long, a_th long, b_none boolean, b_id long, b_th long, n long"


def _linker(size: int, threshold: float):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        """Of the texts in one task: (a, a null b, links of a) and (a, b, 0) for a spanning forest of the links."""
        only = int(rows["only"].iloc[0])  # the band that made the bucket, or -1
        cross = bool((rows["bi"] != rows["bj"]).iloc[0])
        rows = rows.drop_duplicates(NODE).sort_values(NODE)
        sets = gram_sets(*buffers(pa.array(rows["text"], pa.large_string())), size)
        n = len(sets)
        ids = rows[NODE].reset_index(drop=True)

        def ends(a: np.ndarray, b: np.ndarray | None, count: np.ndarray) -> pd.DataFrame:
            one = ids.iloc[a].reset_index(drop=True).add_prefix("a_")
            none = {c: pd.array([None] * len(a), "boolean" if c == "none" else "Int64") for c in NODE}
            two = pd.DataFrame(none) if b is None else ids.iloc[b].reset_index(drop=True).astype({"none": "boolean", "id": "Int64", "th": "Int64"})
            return pd.concat([one, two.add_prefix("b_"), pd.DataFrame({"n": count})], axis=1)

        if n < 2:
            return ends(np.zeros(0, int), None, np.zeros(0, np.int64))
        bands, block = np.stack(rows["bands"].to_list()).astype(np.int64), rows["block"].to_numpy()
        sizes = np.array([len(x) for x in sets])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        own = [flat[e - k : e] for e, k in zip(np.cumsum(sizes), sizes, strict=True)]
        mark = np.zeros(int(flat.max()) + 1, bool)
        links, parent, forest = np.zeros(n, np.int64), list(range(n)), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for k in range(bands.shape[1]) if only < 0 else [only]:
            order = np.argsort(bands[:, k], kind="stable")
            value = bands[order, k]
            cut = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), n)
            for a, b in zip(cut, cut[1:], strict=False):
                group = np.sort(order[a:b])
                for t in range(len(group) - 1):
                    i, js = group[t], group[t + 1 :]
                    least = threshold * (sizes[i] + sizes[js]) / (1 + threshold)  # of the common n-grams
                    js = js[np.minimum(sizes[i], sizes[js]) >= least - 1e-9]
                    if cross:
                        js = js[block[js] != block[i]]
                    if k:
                        js = js[~(bands[js, :k] == bands[i, :k]).any(1)]
                    if not len(js):
                        continue
                    mark[own[i]] = True
                    common = np.add.reduceat(mark[np.concatenate([own[j] for j in js])], np.cumsum(sizes[js]) - sizes[js], dtype=np.int64)
                    mark[own[i]] = False
                    js = js[common >= threshold * (sizes[i] + sizes[js] - common) - 1e-9]
                    links[i] += len(js)
                    links[js] += 1
                    for j in js.tolist():
                        x, y = root(i), root(j)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            forest.append((i, j))
        some = np.flatnonzero(links)
        found = ends(some, None, links[some])
        if not forest:
            return found
        one, two = np.array(forest).T
        return pd.concat([found, ends(one, two, np.zeros(len(forest), np.int64))], ignore_index=True)

    return link


def _node(doc_id: str = "doc_id", th: str = "th") -> Column:
    """What stands for a text: its id, null ones last, and its hash. It has no nulls inside and sorts by id."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(th).alias("th"))


def _classified(docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, task_grams: int = TASK_GRAMS, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, th, the smallest node of the same n-gram set and of the class (null without words) and n_links of every row;
    and the (doc_id, th) that several rows with words share, if any."""
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    signed = staged(texts.mapInArrow(_signer(size, bands, rows), SIGNATURE))
    repeats = staged(signed.where("grams > 0").groupBy("doc_id", "th").count().where("count > 1").select(_node().alias("node")))
    repeats = None if repeats.isEmpty() else repeats
    copies = staged(signed.where("grams > 0").groupBy("s1", "s2").agg(F.min(_node()).alias("node"), F.count("*").alias("n_copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))

    inside = copies.select("node", F.posexplode("bands").alias("band", "h"))
    buckets = staged(inside.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("node").alias("v")).where("n > 1"))
    stars = inside.join(buckets, ["band", "h"]).where("node <> v").select(F.col("node").alias("u"), "v")
    near = components(stars)  # of candidates
    near = staged(near.join(copies, "node"))
    total = near.groupBy("root").agg(F.sum("grams").alias("total")).withColumn("m", F.ceil(F.col("total") / task_grams).cast("int"))
    deal = max(1, -(-(near.agg(F.sum("grams")).first()[0] or 0) // task_grams))
    members = near.join(total, "root")

    columns = ["node", "bands", "key", "only", "m"]
    small = members.where(F.col("m") == 1).withColumn("key", F.pmod(F.xxhash64("root"), F.lit(deal))).withColumn("only", F.lit(-1)).select(columns)
    middle = members.where((F.col("m") > 1) & (F.col("m") <= most_blocks)).withColumn("key", F.xxhash64(F.lit("component"), "root")).withColumn("only", F.lit(-1)).select(columns)
    # By bucket, where a component is too large to ship each of its texts once for every other block.
    large = members.where(F.col("m") > most_blocks).select("node", "grams", "bands", F.posexplode("bands").alias("only", "h"))
    weight = large.groupBy("only", "h").agg(F.sum("grams").alias("total"), F.count("*").alias("n")).where("n > 1").select("only", "h", F.ceil(F.col("total") / task_grams).cast("int").alias("m"))
    large = large.join(weight, ["only", "h"]).withColumn("key", F.xxhash64(F.lit("bucket"), "only", "h")).select(columns)

    dealt = small.unionByName(middle).unionByName(large).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")
    dealt = dealt.select("*", other).withColumn("bi", F.least("block", "o")).withColumn("bj", F.greatest("block", "o")).drop("m", "o")
    whole = texts.select(_node().alias("node"), "text")
    if repeats is not None:
        whole = whole.join(repeats, "node", "left_anti").unionByName(whole.join(repeats, "node", "left_semi").dropDuplicates(["node"]))
    full = dealt.join(whole, "node").select("node.*", "text", "bands", "block", "key", "only", "bi", "bj")
    found = staged(full.groupBy("key", "only", "bi", "bj").applyInPandas(_linker(size, threshold), LINKS))
    a, b = (F.struct(*[F.col(f"{x}_{c}").alias(c) for c in NODE]) for x in "ab")

    links = found.where("b_id IS NULL").groupBy(a.alias("node")).agg(F.sum("n").alias("n_links"))
    groups = components(found.where("b_id IS NOT NULL").select(a.alias("u"), b.alias("v")))
    known = copies.select("s1", "s2", "node", "n_copies").join(links, "node", "left").join(groups, "node", "left")
    known = staged(known.select("s1", "s2", "n_copies", "node", F.coalesce("root", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    drop(docs.sparkSession, copies, buckets, near, found)
    own = skewed_join(signed.where("grams > 0").select("doc_id", "th", "s1", "s2"), known, ["s1", "s2"], "n_copies", signed.count()).select("doc_id", "th", "node", "class", "n_links")
    none = F.lit(None).cast(known.schema["node"].dataType)
    return own.unionByName(signed.where("grams = 0").select("doc_id", "th", none.alias("node"), none.alias("class"), F.lit(0).cast("long").alias("n_links"))), repeats


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, copy_id, n_links for every row of ``docs`` (doc_id, text).

    class_id is the smallest id of the connected group of near duplicates, copy_id that of the texts with the same n-gram
    set, n_links the number of other such sets that are similar enough."""

    def id_of(node: str) -> Column:
        return F.when(F.col(node).isNull(), F.col("doc_id")).when(~F.col(f"{node}.none"), F.col(f"{node}.id"))

    return _classified(docs, **options)[0].select("doc_id", id_of("class").alias("class_id"), id_of("node").alias("copy_id"), "n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest id, of several texts of this id
    the one of the smallest hash, and any one of rows that share both. Rows without words all stay."""
    rows, repeats = _classified(docs, **options)
    kept = rows.where("class IS NULL OR class = named_struct('none', doc_id IS NULL, 'id', coalesce(doc_id, 0L), 'th', th)").select(_node().alias("node")).distinct()
    node, doc_id, th = (free_name(docs, x) for x in ("__node", "__doc_id", "__th"))
    named = docs.withColumns({doc_id: F.col("doc_id").cast("long"), th: F.xxhash64("text")}).withColumn(node, _node(doc_id, th))
    out = named.join(kept.withColumnRenamed("node", node), node, "left_semi")
    if repeats is not None:
        repeats = repeats.withColumnRenamed("node", node)
        out = out.join(repeats, node, "left_anti").unionByName(out.join(repeats, node, "left_semi").dropDuplicates([node]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
