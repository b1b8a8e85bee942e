"""A corpus pipeline: language identification, line deduplication, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, language, line_dedup, ngram_join, packing
from loomspan.llm.common import free_name, staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that the best language describes worse than its labelled texts, with one
    byte to spare for short ones."""
    trees = language.fit(docs)
    most = language.limit(docs, trees) * F.col("n_bytes") + language.UNIFORM
    return language.predict(docs, trees, docs.columns).where((F.col("lang_pred") != "und") & (F.col("bits") <= most)).select("row.*")


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of later occurrences of three-line windows; all rows stay."""
    done = line_dedup.remove_repeated_lines(docs, free_name(docs, "__n_lines"), free_name(docs, "__n_removed"))
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    keep = [n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*keep)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("lines", deduplicate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs


#: SQL expresses neither the language model nor the packing; tests hold single operators, not the whole, against brute force.
ORACLE_SQL = None
