"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes: for every context of up to three bytes seen in training, how
often each byte followed. A byte's code length is exact under escape method C: a byte seen after the longest known
context costs its share of that context; otherwise an escape is paid and the shorter context's distribution, renormalised
over the bytes that the longer one didn't code, takes over, down to a uniform byte. Statistics are frozen after training,
so each context is one row of code lengths and scoring a whole text is a table lookup for each byte. The language whose
tree needs fewest bits wins; the score is its posterior under equal priors.

Training reads every labelled row that isn't held out, and the limit of code lengths every one that is. N-grams are counted in
the tasks and summed before the driver receives them. The trees have at most ``table_bytes``: contexts of two and three bytes
stay by their largest share in any language, a longer one never without its suffix. They are chosen before counts are
collected: those of other contexts arrive as counts of their suffixes. The driver never works out code lengths: it passes the
counts on, and each Python worker makes the table from them once. There is at most a count for each cell of the table; as most
bytes follow few contexts, counts take a small part of the table's memory.

Defined results: a null text, an empty one and one without a letter get ``und`` and score 0; a tie goes to the language
that sorts first. Without any labelled row every text is ``und``. Rows that repeat are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import drop, staged, table
from loomspan.llm.wordhash import buffers

ORDER = 3
TABLE_BYTES = 64 << 20
#: Bytes that are counted, and that are scored, at a time; rows that are scored at a time.
COUNTED, SCORED, ROWS = 1 << 20, 1 << 17, 500
#: Code lengths that are worked out at a time.
CELLS = 1 << 18
#: Parts that a range of values is cut into, and values of one that are sorted in the driver.
RANGES, FEW = 1000, 10_000
#: Bits of a byte without a model; the share of labelled texts that sets the limit of code lengths, and what is allowed beyond it.
UNIFORM = 8.0
NEARLY_ALL = 0.999
SLACK = 1.1
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def _windows(raw: np.ndarray, off: np.ndarray, classes: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Offset, symbol classes and the classes one to ORDER bytes back, for a bounded number of bytes at a time.

    Before a row's start there is class 0, that of the zero byte."""
    for a in range(0, len(raw), size):
        b = min(len(raw), a + size)
        lead = min(a, ORDER)
        cls = classes[raw[a - lead : b]]
        back = []
        begins = off[np.searchsorted(off, a - ORDER, "left") : np.searchsorted(off, b, "left")]
        for k in range(1, ORDER + 1):
            c = np.zeros(b - a, cls.dtype)
            have = max(0, k - lead)
            c[have:] = cls[lead - k + have : lead - k + b - a]
            for j in range(k):  # the first k bytes of a row don't see the row before
                at = begins + j - a
                c[at[(at >= 0) & (at < b - a)]] = 0
            back.append(c)
        yield a, cls[lead:], back


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram (four bytes, the oldest first), n: the counts of each batch."""
    same = np.arange(256, dtype=np.uint32)
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            raw, off = buffers(batch.column("text").filter(pa.array(langs == lang)))
            for _, b, (p1, p2, p3) in _windows(raw, off, same, COUNTED):
                gram, n = np.unique(p3 << 24 | p2 << 16 | p1 << 8 | b, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Trees:
    """Frozen code lengths: ``row_of`` maps three classes of bytes to a row of ``bits`` [row * width + class, language].

    ``grams`` are, of each language, four bytes as one number and their count; or also how many bytes before the last one are
    counted (three by default): counts whose longer contexts have no room anyway may come summed, with zeros for the rest.
    Only these travel; the table is made where code lengths are first asked for."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, ...]], table_bytes: int = TABLE_BYTES):
        self.langs = sorted(grams)
        self.table_bytes = table_bytes
        self.grams = {x: (g.astype(np.uint32), n, *[r.astype(np.int8) for r in reach]) for x, (g, n, *reach) in grams.items()}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("langs", "table_bytes", "grams")}

    def __getattr__(self, name: str):
        if name not in ("classes", "width", "contexts", "row_of", "bits"):
            raise AttributeError(name)
        self._make()
        return self.__dict__[name]

    def _make(self) -> None:
        grams, table_bytes = self.grams, self.table_bytes
        seen = np.zeros(256, bool)
        seen[0] = True
        for g, *_ in grams.values():
            for k in range(4):
                seen[g >> 8 * k & 255] = True
        # Bytes that training never saw share the last class; each of them costs the same after any context.
        rare = 256 - int(seen.sum())
        self.classes = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int32)
        self.width = w = int(seen.sum()) + 1
        base = np.full(w, 1 / 256)
        base[-1] = max(rare, 1e-9) / 256

        coded = {}
        for x, (g, n, *reach) in grams.items():
            c = [self.classes[g >> 8 * k & 255].astype(np.int64) for k in range(4)]
            coded[x] = (c[3] * w * w + c[2] * w + c[1], c[0], n, reach[0] if reach else np.full(len(g), ORDER))
        self.contexts = [np.unique(np.concatenate([c % w for c, *_ in coded.values()]))]
        most = max(1, table_bytes // (4 * w * max(1, len(grams))) - 1 - len(self.contexts[0]))
        kinds = []
        for k in (2, 3):
            at, inverse = np.unique(np.concatenate([c[reach >= k] % w**k for c, _, _, reach in coded.values()]), return_inverse=True)
            share, begin = np.zeros(len(at)), 0
            for _, _, n, reach in coded.values():
                end = begin + int((reach >= k).sum())
                own = np.bincount(inverse[begin:end], n[reach >= k], len(at)) / n.sum()
                share, begin = np.maximum(share, own), end
            kinds.append((at, share))
        order = np.repeat([2, 3], [len(at) for at, _ in kinds])
        code, share = (np.concatenate(x) for x in zip(*kinds, strict=True))
        chosen = np.lexsort((code, order, -share))[:most]
        two, three = (np.sort(code[chosen[order[chosen] == k]]) for k in (2, 3))
        self.contexts += [two, three[np.isin(three % (w * w), two)]]

        rows, total = np.zeros(1, np.int32), 1
        for contexts in self.contexts:
            rows = np.tile(rows, w)
            rows[contexts] = total + np.arange(len(contexts))
            total += len(contexts)
        self.row_of = rows
        bits = np.empty((total, w, len(self.langs)), np.float32)
        for j, x in enumerate(self.langs):
            a = 0
            for part in self._frozen(*coded[x], base):
                bits[a : a + len(part), :, j] = -np.log2(part)
                a += len(part)
        bits[:, -1, :] += np.log2(max(rare, 1))
        self.bits = bits.reshape(-1, len(self.langs))

    def _frozen(self, code: np.ndarray, symbol: np.ndarray, n: np.ndarray, reach: np.ndarray, base: np.ndarray) -> Iterator[np.ndarray]:
        """The distribution after each context, by escape method C with exclusion, of a bounded number of contexts at a time."""
        w = self.width
        step = max(1, CELLS // w)
        below, prior = base[None, :], np.zeros(1, np.int64)
        for k, contexts in enumerate([np.zeros(1, np.int64), *self.contexts]):
            if not len(contexts):  # no room for this order
                break
            own = code % w**k
            pos = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            of = np.flatnonzero((contexts[pos] == own) & (reach >= k))
            of = of[np.argsort(pos[of], kind="stable")]
            begins = range(0, len(contexts), step)
            cut = np.searchsorted(pos[of], [*begins, len(contexts)])
            done = np.empty((len(contexts) if k < len(self.contexts) else 0, w))  # the longest contexts have none above them
            for a, i, j in zip(begins, cut, cut[1:], strict=False):
                some, have = contexts[a : a + step], of[i:j]
                counts = np.bincount((pos[have] - a) * w + symbol[have], n[have], len(some) * w).reshape(-1, w)
                total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
                shorter = below[np.searchsorted(prior, some % w ** (k - 1)) if k else [0]]
                left = np.where(counts > 0, 0, shorter)
                rest = left.sum(1, keepdims=True)
                scale = np.where(rest > 0, total + kinds, np.maximum(total, 1))
                coded = counts / np.maximum(scale, 1) + left / np.where(rest > 0, rest, 1) * kinds / np.maximum(scale, 1)
                coded = np.where(total > 0, coded, shorter)
                yield coded
                if len(done):
                    done[a : a + len(some)] = coded
            below, prior = done, contexts

    def code_lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        w = self.width
        for a, b, (p1, p2, p3) in _windows(raw, off, self.classes, SCORED):
            at = self.row_of[p3 * (w * w) + p2 * w + p1].astype(np.int64) * w + b
            cost = self.bits[at]
            first = int(np.searchsorted(off, a, "right")) - 1
            last = int(np.searchsorted(off, a + len(b), "left"))
            rows = np.arange(first, last)
            rows = rows[off[rows + 1] > off[rows]]
            out[rows] += np.add.reduceat(cost, np.maximum(off[rows] - a, 0), axis=0, dtype=np.float64)
        return out


def _room(counted: DataFrame, langs: list[str], table_bytes: int) -> DataFrame:
    """k (place of the language, from 1), gram, reach, n for ``Trees``: grams of contexts that have no room in the tables are
    summed by their longest suffix that may have."""
    grams = counted.select(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int").alias("k"), "gram", "n")
    total = {r.k: r.n for r in grams.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    width = len({0} | set(grams.agg(F.collect_set(F.col("gram").bitwiseAND(255))).first()[0])) + 1
    whole = F.create_map(*[F.lit(x) for pair in sorted(total.items()) for x in pair])
    context = F.shiftright("gram", 8)
    each = grams.select("k", "n", F.explode(F.array(F.struct(F.lit(2).alias("reach"), context.bitwiseAND(0xFFFF).alias("code")), F.struct(F.lit(3).alias("reach"), context.alias("code")))).alias("c")).groupBy("k", "c").agg(F.sum("n").alias("n"))
    shares = each.groupBy("c.reach", "c.code").agg(F.max(F.col("n") / whole[F.col("k")]).alias("share"))
    # A suffix has at least the share of its context and comes before it.
    chosen = staged(shares.orderBy(F.desc("share"), "reach", "code").limit(max(1, table_bytes // (4 * width * len(langs)))).select("reach", "code"))
    for reach, mask in ((2, 0xFFFF), (3, 0xFFFFFF)):
        of = F.broadcast(chosen.where(F.col("reach") == reach).select(F.col("code").alias(f"c{reach}")))
        grams = grams.join(of, context.bitwiseAND(mask) == F.col(f"c{reach}"), "left")
    reach = F.when(F.col("c2").isNull(), 1).when(F.col("c3").isNull(), 2).otherwise(3)
    kept = F.when(F.col("reach") == 1, F.col("gram").bitwiseAND(0xFFFF)).when(F.col("reach") == 2, F.col("gram").bitwiseAND(0xFFFFFF)).otherwise(F.col("gram"))
    return grams.withColumn("reach", reach).select("k", "reach", kept.alias("gram"), "n").groupBy("k", "reach", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> Trees | None:
    """Trees of all labelled rows that aren't held out."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id"))).select("lang", "text")
    counted = staged(labelled.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # Numbers instead of names reach the driver.
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    # As Arrow: a row as a Python object would take some twenty times the memory. Four bytes less 2^31 fit an int.
    narrow = "k", F.col("reach").cast("tinyint").alias("reach"), (F.col("gram") - 2**31).cast("int").alias("gram"), "n"
    found = _room(counted, langs, table_bytes).select(*narrow).toArrow() if langs else None
    drop(docs.sparkSession, counted)
    if found is None:
        return None
    k, gram, n, reach = (found[c].to_numpy() for c in ("k", "gram", "n", "reach"))
    gram = gram.astype(np.int64) + 2**31
    return Trees({x: (gram[k == j], n[k == j].astype(np.float64), reach[k == j]) for j, x in enumerate(langs, 1)}, table_bytes)


def _quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of all values of the column ``v``, between neighbours in proportion; null without any.

    A range is cut into parts whose rows are counted, and the part of the wanted rank is cut again until it has few rows."""
    v = F.col("v")
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return None
    first, rest = divmod((n - 1) * share, 1)
    rank, size = int(first), n  # among the values from ``low`` to ``high``
    while low < high and size > FEW:
        place = F.least(F.floor((v - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        for part in values.where(v.between(low, high)).groupBy(place.alias("place")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("place").collect():
            if rank < part["n"]:
                break
            rank -= part["n"]
        size, low, high = part["n"], part["low"], part["high"]
    at = low if low == high else sorted(r["v"] for r in values.where(v.between(low, high)).collect())[rank]
    upto, following = values.agg(F.count(F.when(v <= at, 1)), F.min(F.when(v > at, v))).first()
    after = at if upto > first + 1 or following is None else following
    return at + (after - at) * rest


def limit(docs: DataFrame, trees: Trees | None) -> float:
    """Bits a byte above which a text is in none of the languages: a tenth more than nearly all held-out labelled texts
    need under their own language, and never more than a byte that no model describes."""
    if trees is None:
        return UNIFORM
    labelled = docs.where(F.col("lang").isin(trees.langs) & (F.length("text") > 0)).where(held_out(F.col("doc_id"))).select("lang", "text")
    broadcast = docs.sparkSession.sparkContext.broadcast(trees)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            bits = broadcast.value.code_lengths(raw, off)
            own = np.searchsorted(broadcast.value.langs, batch.column("lang").to_pylist()) if len(bits) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(bits[np.arange(len(bits)), own] / np.diff(off))], names=["v"])

    found = staged(labelled.mapInArrow(rates, "v double"))
    broadcast.destroy()  # its rows are staged, and no worker needs to hold two tables
    most = _quantile(found, NEARLY_ALL)
    drop(docs.sparkSession, found)
    return UNIFORM if most is None else min(UNIFORM, SLACK * most)


KIND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("n_bytes", T.LongType())])


def _scorer(broadcast):
    def some(text: pa.Array) -> list[pa.Array]:
        trees = broadcast.value
        letters = np.array([bool(x) and LETTER.search(x) is not None for x in text.to_pylist()], bool)
        raw, off = buffers(text)
        if trees is None:
            lang, p, least = np.full(len(letters), "und", object), np.zeros(len(letters)), np.zeros(len(letters))
        else:
            bits = trees.code_lengths(raw, off)
            least = bits.min(1)
            p = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
            lang = np.array(trees.langs, object)[bits.argmin(1)]
        lang[~letters] = "und"
        return [pa.array(lang, pa.string()), pa.array(np.where(letters, p, 0.0)), pa.array(least), pa.array(np.diff(off).astype(np.int64))]

    def score(text: pa.Array) -> pa.Array:
        parts = [some(text.slice(a, ROWS)) for a in range(0, len(text), ROWS)]
        arrays = [pa.concat_arrays(z) for z in zip(*parts, strict=True)] if parts else [pa.array([], k) for k in (pa.string(), pa.float64(), pa.float64(), pa.int64())]
        return pa.StructArray.from_arrays(arrays, names=KIND.names)

    return score


def predict(docs: DataFrame, trees: Trees | None, keep: list[str]) -> DataFrame:
    """row (a struct of the ``keep`` columns), lang_pred, score, the best language's bits and n_bytes; only ``text`` is an input of the prediction.

    Only texts travel to Python, and only results back."""
    # Else a filter on the result would be pushed below it, and each text be scored twice.
    score = F.arrow_udf(_scorer(docs.sparkSession.sparkContext.broadcast(trees)), KIND).asNondeterministic()
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    return docs.select(row, score("text").alias("found")).select("row", "found.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs), ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
