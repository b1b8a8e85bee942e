"""Token counts under a BPE tokenizer's file, with a shortcut for strings that are one token.

``proven`` shows once, on the driver and before any text is read, which vocabulary strings the merges turn into that one
token when they stand alone as a pre-token. That set is at most the vocabulary, so it is broadcast. A task splits texts into
pre-tokens; proven ones count 1 by a look-up, and only the rest go through the merges. Texts are rows of their own: there is
no shuffle, and a text over ``SLICE`` characters is taken in slices that end at a space, which no pre-token crosses.

Splitting follows the file. Where its pattern is ``WORDS`` and its normaliser NFC, white space and lower case, texts in ASCII
are normalised and split here; letters up to U+024F are split here after the library has normalised them; all other texts
are normalised and split by the library. Strings of added tokens inside a text count 1, as is the library's default.

Defined results: a null text counts as empty and has 0 bytes and tokens; rows that repeat are counted each for itself; an
empty table gives an empty result. Files that aren't BPE over bytes raise ``ValueError``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm.common import table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
SLICE = 1 << 20
#: Rests of up to this length are remembered, so many at a time.
REMEMBERED_CHARS, REMEMBERED = 32, 200_000
# The pattern and the normaliser of files whose texts are split here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
BEYOND_LATIN = re.compile("[^\0-ɏ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: its own where it prints, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


LETTERS = byte_letters()


def _parts(spec: dict | None, key: str) -> list[dict]:
    return [] if spec is None else spec[key] if spec["type"] == "Sequence" else [spec]


def proven(path: str) -> frozenset[str]:
    """The pre-tokens, as text, that are proven to be one token each: all of the vocabulary strings on which the merges end
    in that very string."""
    with open(path) as file:
        model = json.load(file)["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        raise ValueError("not a BPE file with certain merges")
    merges, end = Tokenizer.from_file(path).model, model.get("end_of_word_suffix") or ""
    byte_of = {c: b for b, c in enumerate(LETTERS)}
    found = set()
    for string in model["vocab"]:
        body = string.removesuffix(end)
        if len(body) + len(end) != len(string) or not body or not set(body) <= byte_of.keys():
            continue
        try:
            text = bytes(byte_of[c] for c in body).decode()
        except UnicodeDecodeError:
            continue
        tokens = merges.tokenize(body)
        if len(tokens) == 1 and tokens[0].value == string:
            found.add(text)
    return frozenset(found)


class Counter(dict):
    """Tokens by pre-token: 1 for the proven ones, the others by the merges; short ones are remembered."""

    def __init__(self, path: str, single: Iterable[str]):
        super().__init__(dict.fromkeys(single, 1))
        self.tokenizer, self.least = Tokenizer.from_file(path), len(self)
        with open(path) as file:
            spec = json.load(file)
        splits = _parts(spec["pre_tokenizer"], "pretokenizers")
        if not splits or splits[-1]["type"] != "ByteLevel" or any(s.get("add_prefix_space") for s in splits):
            raise ValueError("not a tokenizer over bytes")
        own = splits[0]["type"] == "Split" and splits[0]["pattern"] == {"Regex": WORDS} and splits[0]["invert"] and len(splits) == 2
        self.words = own and _parts(spec["normalizer"], "normalizers") == NORMALISER
        added = spec["added_tokens"]
        self.plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        self.added = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.model.tokenize("".join([LETTERS[b] for b in piece.encode()])))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= self.least + REMEMBERED:
                for key in [*self][self.least :]:
                    del self[key]
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if self.words and text.isascii():
            return ASCII.findall(text.lower())
        normal = text if self.tokenizer.normalizer is None else self.tokenizer.normalizer.normalize_str(text)
        if self.words and not BEYOND_LATIN.search(normal):
            return LATIN.findall(normal)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> int:
        if self.added is not None and self.added.search(text):
            if not self.plain:
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return len(self.added.findall(text)) + sum(map(self.count, self.added.split(text)))
        parts = slices(text) if self.words else [text]
        return sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of ``size`` characters or, up to the next space, more."""
    at = 0
    while len(text) - at > size and (cut := text.find(" ", at + size)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs`` (doc_id, text)."""
    path = path or public_tokenizers.path(TOKENIZER)
    single = docs.sparkSession.sparkContext.broadcast(proven(path))
    loaded: dict[str, Counter] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in loaded:
            loaded[path] = Counter(path, single.value)
        for batch in batches:
            n = pa.array([loaded[path].count(x) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
