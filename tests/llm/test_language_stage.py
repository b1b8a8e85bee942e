"""The pipeline's language stage on foreign, random and short texts, and against a plain computation."""

import pickle
import random
import tracemalloc

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomspan.llm import language
from loomspan.llm.wordhash import buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rates(trees, texts):
    raw, off = buffers(pa.array(texts))
    return trees.code_lengths(raw, off) / np.diff(off)[:, None]


def test_foreign_and_short_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(1)
    rejected = [
        "".join(rng.choice("0123456789abcdef") for _ in range(400)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)), "7 4 9 {} ## x 99 11",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。",
    ]
    kept = ["Von.", "Osrañ.", "That it.", "Erinst resh.", "un", "the", "de", "a"]
    rows = [(-1 - k, x, None, "s", len(x)) for k, x in enumerate(rejected + kept)]
    mixed = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, mixed, sf).where("doc_id < 0").collect()}
    assert got == {-1 - k for k in range(len(rejected), len(rows))}


def test_limit_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trees = language.fit(docs)
    held = [r for r in docs.where(language.held_out(docs.doc_id)).where("text <> '' AND lang IS NOT NULL").collect()]
    own = [float(rates(trees, [r.text])[0, trees.langs.index(r.lang)]) for r in held]
    most = language.limit(docs, trees)
    assert np.isclose(most, min(8.0, 1.1 * np.quantile(own, 0.999)))
    want = {r.doc_id for r in docs.collect() if r.text and language.LETTER.search(r.text) and rates(trees, [r.text]).min() * len(r.text.encode()) <= most * len(r.text.encode()) + 8}
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()} == want
    assert language.limit(docs.limit(0), trees) == 8.0 == language.limit(docs, None)


def many(spark, n=9000):
    """More rows of a language than were once read of one."""
    rng = random.Random(5)
    words = [["der", "die", "und", "Haus", "gelb"], ["the", "and", "house", "blue", "that"]]
    rows = [(k, " ".join(rng.choice(words[k % 2]) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", " zq", f" {k}"]), ["de", "en"][k % 2], "s", 1) for k in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def counted(rows, held):
    """Four bytes as a number and their count, of each language."""
    out = {}
    for _, text, lang, *_ in (r for r in rows if r[0] not in held):
        raw = bytes(3) + text.encode()
        out.setdefault(lang, Counter()).update(int.from_bytes(raw[i : i + 4], "big") for i in range(len(raw) - 3))
    return {x: (np.array(sorted(c)), np.array([c[g] for g in sorted(c)], float)) for x, c in out.items()}


@pytest.mark.parametrize("table_bytes", [64 << 20, 40_000, 9_000])
def test_model_and_limit_of_all_rows(spark, table_bytes):
    rows, docs = many(spark)
    held = {r[0] for r in docs.where(language.held_out(docs.doc_id)).select("doc_id").collect()}
    want, got = language.Trees(counted(rows, held), table_bytes), language.fit(docs, table_bytes=table_bytes)
    assert got.langs == want.langs and (got.classes == want.classes).all() and (got.row_of == want.row_of).all() and np.array_equal(got.bits, want.bits)
    assert table_bytes > 1 << 20 or len(want.contexts[2]) < len(language.Trees(counted(rows, held)).contexts[2])
    bits = rates(want, [r[1] for r in rows if r[0] in held])
    own = [float(b[want.langs.index(r[2])]) for b, r in zip(bits, (r for r in rows if r[0] in held), strict=True)]
    assert np.isclose(language.limit(docs, got), min(8.0, 1.1 * np.quantile(own, 0.999)), rtol=1e-12)


def test_exact_quantile(spark, monkeypatch):
    monkeypatch.setattr(language, "FEW", 3)
    monkeypatch.setattr(language, "RANGES", 4)
    rng = random.Random(2)
    for values in ([], [1.5], [2.0] * 50, [rng.random() ** 9 * 100 for _ in range(400)], [1.0] * 90 + [1.0 + 2**-52] * 7 + [9.0] * 4, [1e-300, 0.0] * 5):
        for share in (0.0, 0.5, 0.96, 0.999, 1.0):
            got = language._quantile(spark.createDataFrame([(x,) for x in values], "v double"), share)
            assert got is None if not values else np.isclose(got, np.quantile(values, share), rtol=1e-14, atol=0), (values[:5], share)


def test_trees_in_bounded_memory():
    """The driver makes the code lengths of a full table in little more than the table takes."""
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 60, (300_000, 4)) @ (256 ** np.arange(4)))
    table_bytes = 32 << 20
    tracemalloc.start()
    trees = language.Trees({"en": (grams, rng.integers(1, 9, len(grams)).astype(float))}, table_bytes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.8 * table_bytes < trees.bits.nbytes <= table_bytes and most < 4 * table_bytes, most
    # Each context's bytes share one distribution; those never seen cost the last class each.
    p = np.exp2(-trees.bits[:, 0].astype(float)).reshape(-1, trees.width)
    assert np.allclose(p[:, :-1].sum(1) + (257 - trees.width) * p[:, -1], 1, atol=1e-4)


@pytest.mark.parametrize("cells", [1, 1000])
def test_trees_in_parts(spark, monkeypatch, cells):
    rows, _ = many(spark, 300)
    whole = language.Trees(counted(rows, set()))
    monkeypatch.setattr(language, "CELLS", cells)
    assert np.array_equal(language.Trees(counted(rows, set())).bits, whole.bits)


def traced(f):
    """What f returns, and the most bytes of Python that it took."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_driver_never_holds_the_table():
    """What the driver makes and passes on are counts; each worker makes the table, in little more than the table takes."""
    rng = np.random.default_rng(4)
    grams = np.unique(rng.integers(0, 60, (200_000, 4)) @ (256 ** np.arange(4)))
    of = {"en": (grams, rng.integers(1, 9, len(grams)).astype(float))}
    sent, most = traced(lambda: pickle.dumps(language.Trees(of, 32 << 20), 5))
    assert len(sent) < 16 * len(grams) and most < 32 * len(grams), (len(sent), most)
    arrived = pickle.loads(sent)
    bits, most = traced(lambda: arrived.bits)
    assert 0.8 * (32 << 20) < bits.nbytes <= 32 << 20 and most < 4 * (32 << 20), most
    assert len(pickle.dumps(arrived, 5)) == len(sent) and np.array_equal(bits, language.Trees(of, 32 << 20).bits)


def test_fit_in_little_memory_of_the_driver(spark):
    """Counts reach the driver as columns, not as a Python object each."""
    rng = random.Random(6)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400)), "en", "s", 400) for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    language.fit(docs.limit(5))
    n = sum(len(g) for g, _ in counted(rows, {r[0] for r in docs.where(language.held_out(docs.doc_id)).collect()}).values())
    _, most = traced(lambda: language.fit(docs))
    assert n > 100_000 and most < 100 * n, (n, most)


def test_counts_of_high_bytes(spark):
    rows = [(k, "äß€ 😀 ÿ߿" * (k % 5 + 1) + f" né{k}", ["de", "fr"][k % 2], "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want, got = language.Trees(counted(rows, {r[0] for r in docs.where(language.held_out(docs.doc_id)).collect()})), language.fit(docs)
    assert (got.row_of == want.row_of).all() and np.array_equal(got.bits, want.bits)
    assert max(g.max() for g, *_ in got.grams.values()) >= 2**31
