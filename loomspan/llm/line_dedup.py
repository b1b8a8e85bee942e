"""Line deduplication over overlapping windows of three consecutive lines.

Every window is hashed to 128 bits; a window that occurs again later, in the order of (doc_id, line), is a repeat, and
the union of the repeats' lines is removed. Windows travel as (hash, id, line): no text is shuffled to find repeats. The
grouping aggregates before its shuffle; in the join back on the hash the frequent windows, which are few, are broadcast.

Defined results: a null or empty text has no window and stays as it is; so does a text of fewer than three lines. Rows
that share doc_id and text count as one document and are treated alike, those that share only doc_id are told apart by a hash
of the text and come in its order; a null doc_id comes before all others. A document
of which every line goes stays as a row of empty text. Lines are compared exactly, split at ``\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import free_name, skewed_join, staged, table

WINDOW = 3


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), pos: the start line of every window that has an earlier occurrence."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("ls"))
    hashed = lines.where(F.size("ls") >= window).select(
        "doc_id", "th", F.transform("ls", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))).alias("hs")
    )

    def at(i, k):
        return F.element_at("hs", i + k + 1)

    windows = hashed.select(
        "doc_id", "th",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - window), lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[at(i, k)["a"] for k in range(window)]).alias("h1"),
            F.xxhash64(*[at(i, k)["b"] for k in range(window)]).alias("h2"),
        ))).alias("w"),
    ).select("doc_id", "th", "w.*")
    place = F.struct("doc_id", "th", "pos")
    seen = staged(windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    return skewed_join(windows, seen, ["h1", "h2"], "n", total).where(~same).select("doc_id", "th", "pos")


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("n_removed", T.IntegerType()))
def _without(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, starts in it:
        out = []
        for text, at in zip(texts, starts, strict=True):
            if text is None:
                out.append((None, 0))
                continue
            ls = text.split("\n")
            gone = np.zeros(len(ls), bool)
            at = np.asarray(at)
            for k in range(WINDOW):
                gone[at + k] = True
            out.append(("\n".join(x for x, g in zip(ls, gone, strict=True) if not g), int(gone.sum())))
        yield pd.DataFrame(out, columns=["text", "n_removed"])


def remove_repeated_lines(docs: DataFrame, n_lines: str = "__n_lines", n_removed: str = "__n_removed") -> DataFrame:
    """``docs`` with the lines of repeated windows removed from text, and the numbers of lines before and of removed ones.

    A text is filtered in one pass with a mask, however many of its lines go; Spark's own look-ups in arrays and maps would
    take a pass for each line. Texts that lose no line don't travel to Python."""
    i, h, pos, x = (free_name(docs, c) for c in ("__id", "__th", "__pos", "__x"))
    gone = repeated_windows(docs).groupBy(F.col("doc_id").alias(i), F.col("th").alias(h)).agg(F.collect_set("pos").alias(pos))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    joined = docs.join(gone, same, "left").withColumn(x, _without(F.when(F.col(pos).isNotNull(), F.col("text")), pos))
    kept = F.when(F.col(pos).isNull(), F.col("text")).otherwise(F.col(f"{x}.text")).alias("text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    keep = [kept if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*keep, lines.alias(n_lines), F.coalesce(f"{x}.n_removed", F.lit(0)).alias(n_removed))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_removed for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs).select(
        "doc_id", "text", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed")
    )


OP1_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
w AS (SELECT doc_id, pos, [line, lead(line, 1) OVER d, lead(line, 2) OVER d] AS win, lead(pos, 2) OVER d AS last
      FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w WHERE last IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
         FROM e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY e.doc_id),
cnt AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id LEFT JOIN cnt ON l.doc_id = cnt.doc_id
"""
