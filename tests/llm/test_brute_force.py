"""Operators against plain Python versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from loomspan.llm import bcr, common, decontaminate, exact_dedup, html_text, language, line_dedup, ngram_join, packing, pii, substring_dedup, url_filter

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def real(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_shared_windows():
    """Strings with a common core at chosen places: every window that occurs in two of them is found, and no other."""
    rng = random.Random(1)
    for _ in range(300):
        core, side = rng.randint(1, 12), rng.randint(0, 40)
        length = core + side
        middles = [bytes(rng.choice(b"ab") for _ in range(core)) for _ in range(rng.randint(1, 3))]
        around = [bytes(rng.choice(b"ab") for _ in range(side)) for _ in range(3)]
        strings, left, count = [], [], []
        for _ in range(rng.randint(0, 9)):
            far = rng.randint(0, side)  # windows start from far to near bytes before the core
            near = rng.randint(0, far)
            ahead = bytearray(rng.choice(around)[side - far :])
            behind = bytearray(rng.choice(around)[: side - near])
            for part in (ahead, behind):
                if part and rng.random() < 0.4:
                    part[rng.randrange(len(part))] = 99
            strings.append(bytes(ahead) + rng.choice(middles) + bytes(behind))
            left.append(far)
            count.append(far - near + 1)
        seen = Counter((left[i] - j, s[j : j + length]) for i, s in enumerate(strings) for j in range(count[i]))
        want = [(i, j) for i, s in enumerate(strings) for j in range(count[i]) if seen[left[i] - j, s[j : j + length]] > 1]
        found = bcr.shared_windows(strings, np.array(left, np.int32), np.array(count, np.int32), length, core)
        assert sorted((i, j) for i, a, n in found.tolist() for j in range(a, a + n)) == want


def repeats(docs, n):
    seen = Counter(t[k : k + n] for _, t in docs for k in range(len(t) - n + 1))
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = True
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i] = (len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [1 << 20, 300, 40])
def test_substring_dedup(spark, bucket):
    rng = random.Random(3)
    base = [bytes(rng.choice(b"abc") for _ in range(60)) for _ in range(4)]
    docs = [(i, b"".join(rng.choice(base)[rng.randrange(30) :][: rng.randrange(40)] + bytes(rng.choice(b"abcdefghij") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6)))) for i in range(60)]
    docs += [(100, b"a" * 300), (101, b""), (102, "äöü".encode() * 9), (103, b"abcd" * 5)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string")
    got = substring_dedup.remove_repeats(df, length=12, cores=(5, 9, 12), bucket_bytes=bucket).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeats(docs, 12)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_substring_dedup_same_id(spark):
    """Rows of one id and different texts, or of the same text, are places of their own."""
    a, b = "abcdefghijklmnopqrst", "ABCDEFGHIJKLMNOPQRST"
    rows = [(1, a + "x" + b), (1, a + "yz"), (2, "0123456789" + b), (3, "u" + a[:12] + "v"), (4, "only once in here"), (4, "only once in here"), (None, b + "-")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=12, cores=(5, 9, 12)).collect()
    want = repeats([(k, t.encode()) for k, (_, t) in enumerate(rows)], 12)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want.values())


def similar(docs):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    rep = {}
    for i in sorted(sets):
        if sets[i]:
            rep.setdefault(sets[i], i)
    links, parent, having = Counter(), {}, defaultdict(list)

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, i in rep.items():
        for j, k in Counter(j for x in g for j in having[x]).items():
            if k >= 0.8 * (len(g) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in g:
            having[x].append(i)
    return {i: (root(rep[g]), rep[g], links[rep[g]]) if g else (i, i, 0) for i, g in sets.items()}


@pytest.mark.parametrize("options", [{}, {"task_grams": 300}, {"task_grams": 100, "most_blocks": 1}])
def test_ngram_join(spark, options):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(6)]
    docs = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(80)] = "Other"
        docs.append((i, " ".join(w)))
    docs += [(200, "one two"), (201, "One, two"), (202, None), (203, "")]
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in got} == similar(docs)


def test_ngram_join_shared_ids(spark):
    """Different texts of one id, and texts without an id, keep links of their own; one row of a class stays."""
    rng = random.Random(6)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (None, near(c)), (7, b), (7, b), (7, b), (8, "!"), (8, "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.copy_id or 0, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    assert got == sorted([(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 2, 1), (3, 1, 3, 1), (0, 0, 0, 1), (0, 0, 0, 1), (7, 1, 1, 1), (7, 1, 1, 1), (7, 1, 1, 1), (8, 8, 8, 0), (8, 8, 8, 0)])
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(df).collect())
    assert len(kept) == 5 and kept[1:] == [(1, a), (1, b), (8, "!"), (8, "!")] and kept[0] in ((0, c), (0, near(c)))
    same = spark.createDataFrame([(5, a), (5, a), (5, a)], df.schema)
    assert [tuple(r) for r in ngram_join.keep_one(same).collect()] == [(5, a)]


def test_bands():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 96


def test_decontaminate(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(n))) for i, n in enumerate([14, 11, 10, 3, 1, 0])]
    items.append((9, "Zebra, zebra zebra"))
    docs = [(i, "; ".join([rng.choice("ABCDEFGh") for _ in range(rng.randrange(40))] + words(items[i % 3][1])[: rng.randrange(15)])) for i in range(50)]
    docs += [(99, "x zebra-zebra ZEBRA zebra y " + "q " * 1500 + items[0][1])]
    schema = "long, text string"
    got = {r.doc_id: r for r in decontaminate.matches(spark.createDataFrame(docs, f"doc_id {schema}"), spark.createDataFrame(items, f"item_id {schema}"), shard_bytes=40).collect()}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            p = words(text)
            n = min(10, len(p))
            for k in range(len(p) - n + 1 if n else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == p[k : k + n]:
                        hit |= set(range(a, a + n))
                        found.add(str(item))
        assert (got[i].n_words, sorted(got[i].hits), sorted(got[i]["items"])) == (len(w), sorted(hit), sorted(found))


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.predict(docs, language.fit(docs), ["doc_id", "lang"]).select("row.*", "lang_pred", "score", language.held_out(language.F.col("row.doc_id")).alias("out")).collect()
    held = [r for r in found if r.out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_is_a_code():
    """Probabilities after every context sum to one, and a text's code length is the sum of its bytes'."""
    gram = np.array([int.from_bytes(x, "big") for x in (b"\0\0\0a", b"\0\0ab", b"\0aba", b"abab", b"baba")])
    trees = language.Trees({"x": (gram, np.array([1.0, 2, 1, 3, 2])), "y": (gram[:2], np.array([1.0, 1]))})
    bits = trees.bits.reshape(-1, trees.width, 2).astype(float)
    weight = np.ones(trees.width)
    weight[-1] = 256 - (trees.width - 1)
    assert np.allclose((np.exp2(-bits) * weight[None, :, None]).sum(1), 1, atol=1e-5)
    raw = np.frombuffer(b"ababab" + b"b", np.uint8)
    both = trees.code_lengths(raw, np.array([0, 6, 6, 7]))
    assert both[1].tolist() == [0, 0] and both[0, 0] < both[0, 1]


def plain_ppm(text, grams, order=3):
    """Bits of ``text`` by prediction by partial matching, escape method C with exclusion, statistics of ``grams`` frozen."""
    seen = defaultdict(Counter)
    for g, n in grams.items():
        for k in range(order + 1):
            seen[g[order - k : order]][g[order]] += n
    known = {}

    def after(context):
        if context is None:
            return [1 / 256] * 256
        if context not in known:
            shorter = after(context[1:] if context else None)
            counts = seen.get(context)
            if counts:
                total, kinds = sum(counts.values()), len(counts)
                rest = sum(p for b, p in enumerate(shorter) if b not in counts)
                scale = total + kinds if rest > 0 else total
                shorter = [counts[b] / scale if b in counts else p / rest * kinds / scale for b, p in enumerate(shorter)]
            known[context] = shorter
        return known[context]

    text = bytes(order) + text
    return -sum(np.log2(after(text[i - order : i])[text[i]]) for i in range(order, len(text)))


@pytest.mark.parametrize("table_bytes", [64 << 20, 30_000])
def test_language_code_lengths(table_bytes):
    """All code lengths are those of the plain method, with all contexts; and no size of tables is exceeded."""
    rng = random.Random(8)
    train = {x: b" ".join(rng.choice([b"der", b"die", b"the", b"that", b"on", "ñö".encode()]) for _ in range(60)) for x in ("a", "b", "c")}
    counted = {x: Counter((bytes(3) + t)[i : i + 4] for i in range(len(t))) for x, t in train.items()}
    grams = {x: (np.array([int.from_bytes(g, "big") for g in c]), np.array(list(c.values()), float)) for x, c in counted.items()}
    trees = language.Trees(grams, table_bytes)
    assert trees.bits.nbytes <= table_bytes
    texts = [b"", b"the", b"xyz \xff", b"der that on the", train["a"][:90]]
    got = trees.code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    if table_bytes > 1 << 20:
        want = [[plain_ppm(t, counted[x]) for x in trees.langs] for t in texts]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    many = {f"l{i}": grams["a"] for i in range(100)}
    assert language.Trees(many, 1 << 20).bits.nbytes <= 1 << 20


def test_packing_round_trip(spark, real):
    got = packing.pack(spark.createDataFrame(real, "doc_id long, text string")).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {i: g.sort_values("start") for i, g in got.groupby("doc_id")}
    for i, text in real:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in pieces[i].itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    placed = got.sort_values(["sequence_id", "offset"])
    full = placed.groupby("sequence_id")["length"]
    assert (placed["offset"] == full.cumsum() - placed["length"]).all() and full.sum().max() <= 2048
    assert got["length"].sum() >= 0.98 * 2048 * got["sequence_id"].nunique()


def test_encoded():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a b", "  a  b ", "a \nb", "\n a\tb c ", "x <|endoftext|> y", "don't we'll", "", " ", "é ü  z", "12 3,4 (5)", " " * 200_000 + "x", "\U0001f600\ud7ff a" * 50, "'s 'S"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(texts, path)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pii_patterns(real):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(text):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
                if k == 0 or k == 1 and all(int(q) <= 255 for q in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn or k == 3 and 10 <= len(d) <= 15:
                    out.append((*m.span(), k))
        return sorted(out, key=lambda x: (x[0], x[2]))

    rng = random.Random(0)
    parts = ["1", "2", "55", "4111111111111111", ".", "@", "a", "+", "-", " ", "(", ")", "b.c", "255", "x@y.z", "é", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(5000)]
    for t in texts + [t or "" for _, t in real]:
        assert pii.base_spans(t) == plain(t)


def test_pii_field(real):
    texts = [t or "" for _, t in real] * 3
    field = pii.Field([(*k, n) for k, n in pii.statistics(texts).items()])

    def added(text):
        return [(text[s:e], pii.KINDS[k]) for s, e, k in field.added([text], [pii.base_spans(text)])[0]]

    assert added("Call +1 (988) 555-2485 now. Later (988) 555-2485 again, but not version 3.0.1 or 4111111111111112.") == [("(988) 555-2485", "phone")]
    # Form alone doesn't decide: the same numbers are taken where an occurrence with a prefix links to them, and left alone elsewhere.
    assert added("Call +1 (988) 555-2485 now" + ", then much text" * 50 + " 988-555-2485 or 9885552485.") == [("988-555-2485", "phone"), ("9885552485", "phone")]
    assert added("Here 988-555-2485 or 9885552485, and 1234 5678 9012 3456, and 17 23 99 of 2020.") == []
    # Numbers that a pattern merges come apart.
    assert added("Des +1 (826) 555-4081 190.137.223.204 du") == [("+1 (826) 555-4081", "phone")]


@pytest.mark.parametrize("seed", range(4))
def test_pii_marginals(seed):
    """Messages give the exact marginals of fields without loops, by enumeration of all labellings."""
    rng = np.random.default_rng(seed)
    g = pii.Graph([], [])
    n, k = 5, len(pii.KINDS) + 1
    g.where, g.features, g.label = [(0, i, i + 1) for i in range(n)], [(f"~{i}", f"s{i}") for i in range(n)], [0, 0, 3, 0, 0]
    g.chain, g.skip = [(0, 1), (1, 2)], [(0, 3), (3, 4)]
    field = pii.Field([])
    field.index = {x: i for i, x in enumerate(sorted({x for f in g.features for x in f}))}
    field.weights = rng.normal(size=(len(field.index) + 1, k))
    field.pair = {"chain": rng.normal(size=(k, k)), "skip": rng.normal(size=(k, k))}
    unary = np.array([field.weights[-1] + sum(field.weights[field.index[x]] for x in f) for f in g.features])
    want = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        if y[2] == 3:
            score = sum(unary[i, y[i]] for i in range(n)) + sum(field.pair["chain"][y[a], y[b]] for a, b in g.chain) + sum(field.pair["skip"][y[a], y[b]] for a, b in g.skip)
            for i in range(n):
                want[i, y[i]] += np.exp(score)
    assert np.allclose(field.marginals(g, rounds=80), want / want.sum(1, keepdims=True), atol=1e-6)


def test_html(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html_text.entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r.html) == "\n\n".join(x for x in parts if x)


def test_html_without_article():
    page = """<html><body><div class="menu"><a href=x>Home</a> <a>News</a></div><div id=wrap><h2>Title &amp; more</h2>
      <p>One long sentence, with marks,   and so on. And another one; it ends here.</p><p>Second long paragraph, again with
      more text, and stops. Yes.</p><ul class=links><li>a<li>b</ul></div><form>Name, please. <input></form>
      <div class="comments"><p>Nice, very nice, I like it. Really.</p></div><div>Copyright 2020</div>"""
    assert html_text.main_text(page) == "Title & more\n\nOne long sentence, with marks, and so on. And another one; it ends here.\n\nSecond long paragraph, again with more text, and stops. Yes."


def test_html_names():
    page = """<body class="has-sidebar"><div class="page no-sidebar" style="overflow:hidden" data-hidden="x"><article><div class="post-header"><h1>Head</h1></div>
      <p style='a:"b"'>Body, one. Two.</p><figure><figcaption>A caption.</figcaption></figure><div class="share-bar">Share, now.</div><div hidden>Gone.</div>
      <aside>Side.</aside><section id="comments"><p>Reader, here.</p></section><p>End &lt;of&gt; text.<br>Same\tblock</article></div>"""
    assert html_text.main_text(page) == "Head\n\nBody, one. Two.\n\nA caption.\n\nEnd <of> text. Same block"


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(80)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in url_filter.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_components_leave_one_table(spark):
    before = len(common._STAGED)
    got = url_filter.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"))
    assert len(common._STAGED) == before + 1
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(41)}


def test_url_aliases(spark):
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="https://foo.net/es/1">'), (2, "http://b.org/y", "<link href='/z' rel=canonical>"),
        (3, "https://b.org/z#q", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'), (4, "http://c.org/", '<link rel="canonical" href="rel/x">'),
        (5, "http://c.org/rel/x", '<link rel=canonical href="http://www.example.com/en/3"><link rel=canonical href="http://net/fr/9">'),
        (8, "HTTP://FOO.Example.COM/en/a?b#c", None), (9, "http://q.org", ""), (10, "http://www.example.com/en/3", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.org", "/x", None, "block"), 2: ("b.org", "/y", None, "block"), 3: ("b.org", "/z", None, "block"), 4: ("c.org", "/", None, "allow"), 5: ("c.org", "/rel/x", None, "allow"),
        8: ("foo.example.com", "/en/a", "example.com/en/", "block"), 9: ("q.org", "", None, "allow"), 10: ("www.example.com", "/en/3", "www.example.com/en/", "allow"),
    }


def test_packing_of_one_text(spark):
    """Rows of one id and text are dealt to several groups."""
    df = spark.createDataFrame([(1, "the same words again " * 100)] * 900, "doc_id long, text string")
    got = packing.pack(df, windows=8).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 5
    assert sum(r.length for r in got) == 900 * got[0].doc_tokens


def test_line_dedup_unchanged_texts_stay(spark, monkeypatch):
    """Only texts that lose lines travel to Python."""
    plain = line_dedup._without.func

    def checked(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in it:
            assert not (texts.notna() & starts.isna()).any()
            yield from plain(iter([(texts, starts)]))

    monkeypatch.setattr(line_dedup, "_without", pandas_udf(checked, line_dedup._without.returnType))
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "y\nz"), (4, ""), (5, None)]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "a\nb\nc\nd", 4, 0), (2, "x", 4, 3), (3, "y\nz", 2, 0), (4, "", 1, 0), (5, None, 0, 0)]


def test_line_dedup_shared_ids(spark):
    """Different texts of one id are different documents: the window that both begin with stays in one of them."""
    same = "a\nb\nc\n"
    rows = [(1, same + "x"), (1, same + "y"), (1, same + "y"), (2, "c\n" + same)]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["__n_removed"] for r in got) in ([0, 0, 3, 3], [0, 3, 3, 3])
    assert {r.text for r in got if r.doc_id == 2} == {"c\n"}


def test_exact_dedup(spark):
    rows = [(3, "a b"), (1, "ab "), (2, " a  b"), (4, None), (5, "\t\x0b"), (6, "\xa0ab"), (7, "ab\u2003"), (None, "ab")]
    for few in (0, 100):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), few).collect()}
        assert got == {3: (2, 4, False), 1: (2, 4, False), 2: (2, 4, True), None: (2, 4, False), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True), 7: (7, 1, True)}
