"""Token counts against the library, and the proof of strings that are one token."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspan.llm import token_counts

PATH = public_tokenizers.path(token_counts.TOKENIZER)
PIECES = [
    *"abc XYZ'sdrevml019  \t\n\x0b\x0c\r\x1c\x1d\x85\xa0.,!?-_", "é", "É", "é", "Σ", "ς", "İ", "ß", "ﬁ", "日", "本", "　", "😀", "½", "²", "Ⅷ", "‍", "﻿", "ॐ", "א", "가", "ᄀ", "ᅡ", "’", "͸",
    "\U0001f1e6", "𐐀", "'LL", "'S", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "ɐ", "ɏ",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH, token_counts.proven(PATH))


def test_proof(library):
    """Every proven string is one token alone; others that are whole pre-tokens aren't."""
    proven = token_counts.proven(PATH)
    assert len(proven) > 30_000 and {"the", "é", "!!!"} <= proven
    sample = random.Random(1).sample(sorted(proven), 3000)
    assert all(library(s) == 1 for s in sample)


def test_mixed_strings(counter, library):
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert counter.count(text) == library(text), repr(text)


def test_slices(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.Counter(PATH, token_counts.proven(PATH))
    text = "Some wörds, it's 12 o'clock é́  unfathomablyness " * 40
    for size in (1, 7, 100):
        assert "".join(token_counts.slices(text, size)) == text
        assert sum(counter.count(part) for part in token_counts.slices(text, size)) == library(text)
    assert list(token_counts.slices("a" * 50, 10)) == ["a" * 50]


def test_other_files(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = sorted((r.doc_id or -1, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()) == want


def test_whole_table(spark, sf, docs, no_docs, library):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), docs):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), library(r.text or "")) for r in df.collect())
        got = token_counts.count_tokens(df).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(no_docs).collect() == []
