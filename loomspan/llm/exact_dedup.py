"""Exact deduplication by a 128-bit content hash, with a byte comparison inside the groups.

One narrow table (id, hash, length) is staged, so that texts are normalised and hashed once. Grouping aggregates before its
shuffle. The texts are read once more for the comparison: only those whose 64-bit hash occurs more than once go on (the hashes
are broadcast where their number is below ``filter_rows``, else joined), and grouping them by hash and bytes, again aggregated
before the shuffle, shows a hash that stands for two texts. Each row then gets its group by a join on the hash, in which the
frequent hashes, which are few, are broadcast, so that no task gets all rows of one.

Defined results: a null text counts as empty; rows of equal original text and equal id tie and are all marked as kept; a
null id comes after every other one. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import free_name, skewed_join, staged, table

WHITE_SPACE = " \t\n\x0b\x0c\r"
FILTER_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _best(n_cp: Column, doc_id: Column) -> Column:
    """The id of the row with the most code points, then the smallest id."""
    return F.max_by(doc_id, F.struct(n_cp, F.coalesce(F.bitwise_not(doc_id), F.lit(-(2**63)))))


def exact_groups(docs: DataFrame, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs`` (doc_id, text)."""
    return _marked(docs, filter_rows).drop("n_cp")


def _marked(docs: DataFrame, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """``exact_groups`` with each row's code points: of rows that share an id, only those of most code points are kept."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"),
    )
    sha = F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha")
    slim = staged(rows.select("doc_id", "n_cp", F.xxhash64("norm").alias("x"), sha)).withColumn("h", F.substring("sha", 1, 16))
    groups = staged(slim.groupBy("h").agg(F.count("*").alias("group_size"), _best(F.col("n_cp"), F.col("doc_id")).alias("keep_id"), F.first("x").alias("x"), F.max("n_cp").alias("most")).where("group_size > 1"))

    # The bytes of all texts that may share a hash.
    several = groups.select("x").distinct()
    few = groups.count() <= filter_rows
    members = rows.select("norm", F.xxhash64("norm").alias("x")).join(F.broadcast(several) if few else several, "x", "left_semi")
    kinds = members.groupBy("x", "norm").agg(F.count("*").alias("n")).select(F.substring(sha, 1, 16).alias("h"))
    collided = staged(kinds.groupBy("h").count().where("count > 1").select("h"))

    out = ["doc_id", "keep_id", "group_size", "sha", "n_cp", "most"]
    found = skewed_join(slim.drop("x"), groups.drop("x"), ["h"], "group_size", slim.count())
    alone = slim.join(groups, "h", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha", "n_cp", F.col("n_cp").alias("most"))
    if collided.isEmpty():
        return _finish(found.select(out).unionByName(alone))
    # Different texts under one hash: there the whole text is the key.
    texts = rows.withColumn("sha", sha).withColumn("h", F.substring("sha", 1, 16)).join(collided, "h", "left_semi")
    exact = texts.groupBy("norm").agg(F.count("*").alias("group_size"), _best(F.col("n_cp"), F.col("doc_id")).alias("keep_id"), F.max("n_cp").alias("most"))
    return _finish(found.join(collided, "h", "left_anti").select(out).unionByName(alone).unionByName(texts.join(exact, "norm").select(out)))


def _finish(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("most"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "n_cp",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat id and text stay together."""
    i, h, n = (free_name(docs, c) for c in ("__kept_id", "__kept_sha", "__kept_n"))
    kept = _marked(docs).where("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(h), F.col("n_cp").alias(n)).distinct()
    text = F.coalesce("text", F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256) == F.col(h)) & (F.char_length(text) == F.col(n))
    return docs.join(kept, same, "left_semi")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm, n_cp, max(n_cp) OVER (PARTITION BY norm) AS most, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND n_cp = most AS kept, sha256(norm) AS text_sha256 FROM w
"""
