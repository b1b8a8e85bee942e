r"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

The nodes of a document's field are its entity-shaped tokens (those with a digit or ``@``; any other token is clamped to
"none"). Neighbouring tokens share a chain edge. Tokens that are equal, or equal after dropping punctuation, or that end
in the same seven or more digits, share a skip edge with their next occurrence however far away it is: linking each
occurrence to the next connects all of them with a linear number of edges. Potentials are trained together by
pseudo-likelihood on spans of the fixed patterns in a bounded sample: a token's label given the shapes of the token and its
neighbours, its number of digits, and the labels across its edges. Each token is seen twice, once with its shapes hidden, so
that the edges learn to decide where a form doesn't. Loopy sum-product messages run over all documents of a batch at once;
tokens inside a pattern's span are observed. Where the marginal for a kind reaches ``least`` over a run of tokens, its longest
parts that can be of that kind (a number of digits, a checksum, a domain) are added unless they touch a pattern's span: so
numbers that a pattern merged with a neighbour come apart, and numbers without a prefix follow their other occurrences.

The search for patterns is linear in the text: addresses grow from each ``@``, numbers begin where a run of digits does.
The trained tables are bounded by the number of shapes in ``sample_docs`` documents. No shuffle is needed beyond training.

Defined results: a null or empty text has no spans; rows that repeat are judged each for itself. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
ROUNDS = 12
LEAST = 0.9
#: Log-odds that the skip edges' table is drawn to for equal kinds, and those of "none" for a token whose shape training never saw.
CONSISTENT, UNSEEN = 8.0, 3.0
#: Characters that an equal token must have to be linked: short numbers are equal by chance.
LINKED = 5
#: No kind has more digits than a card.
MOST_DIGITS = 19

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SHAPED = re.compile(r"[0-9@]+")
DIGIT = re.compile(r"[0-9]")
TRIM_LEFT, TRIM_RIGHT = "\"'<[{", "\"'>]}.,;:!?"

Span = tuple[int, int, int]  # start, end, index of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns by start, then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        out += [(*m.span(), 1) for m in IP.finditer(text) if is_ip(m[0])]
        out += [(*m.span(), 2) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and is_card(m[0])]
        if "+" in text:
            out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def tokens(text: str) -> list[tuple[int, int]]:
    """Entity-shaped tokens: runs without white space that hold a digit or ``@``, without quotes and stops around."""
    out, end = [], 0
    for m in SHAPED.finditer(text):
        if m.start() < end:
            continue
        s, e = m.span()
        while s > end and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        end = e
        while s < m.start() and text[s] in TRIM_LEFT:
            s += 1
        while e > m.end() and text[e - 1] in TRIM_RIGHT:
            e -= 1
        out.append((s, e))
    return out


def shape(token: str) -> str:
    """Runs of digits by their length, of letters as one letter; numbers that a checksum or range decides carry it."""
    if "@" in token:
        left, _, right = token.partition("@")
        return "x@x.x" if left and DOMAIN.fullmatch(right) else "@"
    if IP.fullmatch(token):
        return "ip" if is_ip(token) else "no ip"
    if CARD.fullmatch(token) and len(token) >= 14:
        return "card" if is_card(token) else "no card"
    runs = re.sub(r"[^\W\d_]+", "a", DIGIT.sub("0", token))
    return runs if len(runs) <= 40 else f"# {hashlib.blake2b(runs.encode(), digest_size=8).hexdigest()}"


def size(token: str) -> str:
    """The numbers of digits and of dots, and whether there is something else than numbers have."""
    return f"~{len(DIGIT.findall(token))}.{token.count('.')}{'@' if '@' in token else ''}{'a' if re.search(r'[^\W\d_]', token) else ''}"


def keys(token: str) -> list[str]:
    """What tokens that share a skip edge have in common."""
    plain = re.sub(r"[\W_]+", "", token).casefold()
    if len(plain) >= 7 and plain.isdecimal():
        return [f"…{plain[-7:]}"]
    return [plain] if len(plain) >= LINKED else []


class Graph:
    """The fields of several documents as one: tokens, features, observed labels (0 none known) and edges."""

    def __init__(self, texts: list[str], spans: list[list[Span]]):
        self.where: list[tuple[int, int, int]] = []  # document, start, end
        self.features: list[tuple[str, ...]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        for d, (text, known) in enumerate(zip(texts, spans, strict=True)):
            found = tokens(text)
            if not found:
                continue
            first = len(self.where)
            shapes = [shape(text[s:e]) for s, e in found]
            near = [b[0] - a[1] <= 2 for a, b in zip(found, found[1:], strict=False)]
            last: dict[str, int] = {}
            k, n = 0, len(found)
            for i, (s, e) in enumerate(found):
                left = shapes[i - 1] if i and near[i - 1] else "-"
                right = shapes[i + 1] if i + 1 < n and near[i] else "-"
                self.features.append((size(text[s:e]), shapes[i], f"{left} < {shapes[i]}", f"{shapes[i]} > {right}"))
                while k < len(known) and known[k][1] <= s:
                    k += 1
                self.label.append(next((c + 1 for a, b, c in known[k : k + 4] if a < e and s < b), 0))
                self.where.append((d, s, e))
                if i and near[i - 1]:
                    self.chain.append((first + i - 1, first + i))
                for key in keys(text[s:e]):
                    if key in last:
                        self.skip.append((last[key], first + i))
                    last[key] = first + i


def statistics(texts: list[str]) -> Counter:
    """Counts of (features, label before, label behind, labels across skip edges, label); -1 where there is no token."""
    g = Graph(texts, [base_spans(x) for x in texts])
    before, behind = [-1] * len(g.label), [-1] * len(g.label)
    across: list[list[int]] = [[] for _ in g.label]
    for a, b in g.chain:
        before[b], behind[a] = g.label[a], g.label[b]
    for a, b in g.skip:
        across[a].append(g.label[b])
        across[b].append(g.label[a])
    out: Counter = Counter()
    for f, *context, linked, y in zip(g.features, before, behind, across, g.label, strict=True):
        linked = ",".join(map(str, sorted(linked)))
        out["\x1f".join(f), *context, linked, y] += 1
        out[f[0], *context, linked, y] += 1
    return out


class Field:
    """Trained potentials: a row of weights for each feature, and tables of pairs of labels for both kinds of edge."""

    def __init__(self, counts: list[tuple[str, int, int, str, int, int]], rounds: int = 300, ridge: float = 1.0):
        n = len(KINDS) + 1
        rows: dict[tuple[str, int, int, str], np.ndarray] = {}
        for f, left, right, linked, y, c in counts:
            rows.setdefault((f, left, right, linked), np.zeros(n))[y] += c
        kinds = sorted(rows)
        self.index = {f: i for i, f in enumerate(sorted({x for k in kinds for x in k[0].split("\x1f")}))}
        self.weights = np.zeros((len(self.index) + 1, n))  # the last row goes with every token
        # Occurrences of one thing tend to be of one kind: what the tables start from and are drawn to.
        consistent = np.diag(np.append(0.0, np.full(n - 1, CONSISTENT)))
        self.pair = {"chain": np.zeros((n, n)), "skip": consistent.copy()}
        if not kinds:
            self.weights[-1, 0] = 2.0
            return
        flat = [[self.index[x] for x in k[0].split("\x1f")] for k in kinds]
        row, at = np.repeat(np.arange(len(kinds)), [len(x) for x in flat]), np.concatenate(flat)
        left, right = (np.array([k[j] for k in kinds]) for j in (1, 2))
        hasl, hasr = np.flatnonzero(left >= 0), np.flatnonzero(right >= 0)
        linked = np.array([np.bincount([int(x) for x in k[3].split(",") if x], minlength=n) for k in kinds])
        y = np.array([rows[k] for k in kinds])
        total = y.sum(1, keepdims=True)
        # Steps by a bound of the curvature: each row's count times the number of weights that act on it, over two.
        act = total * (np.bincount(row, minlength=len(kinds)) + 1 + (left >= 0) + (right >= 0) + linked.sum(1))[:, None] / 2
        hess = np.full((len(self.weights), 1), ridge)
        np.add.at(hess, at, act[row])
        hess[-1] += act.sum()
        h_chain = ridge + act[hasl].sum() + act[hasr].sum()
        h_skip = ridge + 2 * (act * linked.sum(1, keepdims=True)).sum()
        for _ in range(rounds):
            z = np.tile(self.weights[-1], (len(kinds), 1))
            np.add.at(z, row, self.weights[at])
            z[hasl] += self.pair["chain"][left[hasl]]
            z[hasr] += self.pair["chain"][:, right[hasr]].T
            z += linked @ self.pair["skip"]
            p = np.exp(z - z.max(1, keepdims=True))
            rest = y - total * p / p.sum(1, keepdims=True)
            grad = -ridge * self.weights
            np.add.at(grad, at, rest[row])
            grad[-1] += rest.sum(0)
            chain, skip = -ridge * self.pair["chain"], linked.T @ rest
            np.add.at(chain, left[hasl], rest[hasl])
            np.add.at(chain.T, right[hasr], rest[hasr])
            self.weights += grad / hess
            self.pair["chain"] += chain / h_chain
            self.pair["skip"] += (skip + skip.T - 2 * ridge * (self.pair["skip"] - consistent)) / h_skip

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Label marginals of each token by loopy sum-product with damping."""
        n, m = len(KINDS) + 1, len(g.where)
        unary = np.tile(self.weights[-1], (m, 1))
        for i, f in enumerate(g.features):
            for x in f:
                k = self.index.get(x)
                if k is not None:
                    unary[i] += self.weights[k]
            unary[i, 0] += UNSEEN * (f[1] not in self.index)
        label = np.array(g.label)
        seen = np.flatnonzero(label)
        unary[seen] = -30.0
        unary[seen, label[seen]] = 0.0
        unary -= unary.max(1, keepdims=True)
        edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
        if len(edges):
            source, target = np.concatenate([edges, edges[:, ::-1]]).T
            pair = np.concatenate([np.tile(self.pair["chain"], (len(g.chain), 1, 1)), np.tile(self.pair["skip"], (len(g.skip), 1, 1))])
            pair = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((len(source), n))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, target, message)
                out = belief[source] - message[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.maximum(np.einsum("ea,eab->eb", out, pair), 1e-30))
                new -= new.max(1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            np.add.at(unary, target, message)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, texts: list[str], spans: list[list[Span]], least: float = LEAST) -> list[list[Span]]:
        g = Graph(texts, spans)
        out: list[list[Span]] = [[] for _ in texts]
        if not g.where:
            return out
        p = self.marginals(g)
        best = np.where((p[:, 1:].max(1) >= least) & (np.array(g.label) == 0), p[:, 1:].argmax(1), -1)
        joined = set(g.chain)
        i = 0
        while i < len(best):
            if best[i] < 0:
                i += 1
                continue
            j = i + 1
            while j < len(best) and best[j] == best[i] and (j - 1, j) in joined:
                j += 1
            self._parts(g, i, j, int(best[i]), texts, spans, out)
            i = j
        return out


    @staticmethod
    def _parts(g: Graph, i: int, j: int, kind: int, texts: list[str], spans: list[list[Span]], out: list[list[Span]]) -> None:
        """Adds the longest parts of the tokens i to j that have the kind's form, from the left."""
        d = g.where[i][0]
        while i < j:
            s, last, digits = g.where[i][1], i, 0
            for k in range(i, j):
                digits += len(DIGIT.findall(texts[d][g.where[k][1] : g.where[k][2]]))
                if digits > MOST_DIGITS and kind:
                    break
                if _has_form(texts[d][s : g.where[k][2]], kind):
                    last = k + 1
            if last > i:
                e = g.where[last - 1][2]
                if not any(a < e and s < b for a, b, _ in spans[d]):
                    out[d].append((s, e, kind))
            i = max(last, i + 1)


def _has_form(text: str, kind: int) -> bool:
    if kind == 0:
        left, _, right = text.partition("@")
        return bool(left) and DOMAIN.fullmatch(right) is not None
    if kind == 1:
        return IP.fullmatch(text) is not None and is_ip(text)
    if kind == 2:
        return CARD.fullmatch(text) is not None and is_card(text)
    return 7 <= len(DIGIT.findall(text)) <= 15 and re.fullmatch(r"[ ()+./0-9-]+", text) is not None


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Potentials from about ``sample_docs`` documents at most, chosen by a hash of the id and the text's length."""
    n = docs.count()
    share = int(min(1.0, sample_docs / max(n, 1)) * 1_000_000)
    sample = docs.where("text IS NOT NULL").where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*k, c) for k, c in statistics(batch.column(0).to_pylist()).items()]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["f", "before", "behind", "across", "y", "n"])

    key = ["f", "before", "behind", "across", "y"]
    counted = sample.select("text").mapInArrow(count, "f string, before int, behind int, across string, y int, n long").groupBy(*key).agg(F.sum("n").alias("n"))
    return Field([tuple(r) for r in counted.orderBy(*key).collect()])


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _finder(broadcast):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = broadcast.value
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            base = [base_spans(x) for x in texts]
            more = field.added(texts, base)
            counts = np.zeros((len(KINDS), len(texts)), np.int64)
            for i, spans in enumerate(base):
                for _, _, k in spans:
                    counts[k, i] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array([hashlib.sha256(_digest(x).encode()).hexdigest() for x in base], pa.string()), pa.array([_digest(a + b) for a, b in zip(base, more, strict=True)], pa.string())],
                names=names,
            )

    return find


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts and hash of the fixed patterns' spans, and all spans, of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(field)), schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))
