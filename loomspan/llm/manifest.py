"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups' roots.

Rows become leaves, numbered within their group by ``ranked`` (one range shuffle of narrow rows). Levels are windows: the
nodes of a group that share a parent index are one window partition, whose ordered ``collect_list`` over the full frame
gives each of them its run, hence the parent's preimage and its own siblings. ``LEVELS`` levels are climbed between two
shuffles, as rows dealt by (group, block of arity^LEVELS leaves) already lie as each of these windows needs them. Within a
block only the first row of a node brings its digest into the next level's list, so a parent counts once; between blocks
the parents are real rows, one each. Then paths go down again by joins of a block's rows with its one parent row.

No window, list or join key gets more than arity^LEVELS rows, whatever the groups' sizes. Digests are hex text, as hashed.

Defined results: rows come in the order of key (null first), then of their leaf's digest; equal rows tie and get the places
next to each other. A null group is a group of its own and the first. A single leaf is its group's root, and a single group
the dataset's. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import staged, table

ARITY = 2
LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEPS = "array<struct<before:string,after:string>>"
#: Rows with paths that are broadcast at most: at 128 bytes a level, some 18 MB for 34 levels.
BROADCAST_ROWS = 4096
EACH_TAMPERED = 7


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def field(value: Column) -> Column:
    """A value in a leaf's preimage: ``-`` for null, else its UTF-8 bytes behind their number."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return sha(F.concat(*map(field, values)))


def group_key(group: Column) -> Column:
    """Text that orders as the group does, with null first: no group's key is null."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order within each group, and ``n``, the group's size.

    A range shuffle by group and order puts each group's rows side by side, however many tasks they fill; a row's number in
    its task and the counts of the tasks before give its place. ``rows`` must be read from a table."""
    by = [group, *order]
    laid = rows.repartitionByRange(*by, F.rand(0)).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    laid = staged(laid).withColumn("task", F.shiftright("at", 33))
    spans = laid.groupBy("task", group).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy(group).orderBy("task")) - F.col("here")
    spans = spans.select("task", group, (before - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy(group)).alias("n"))
    return laid.join(spans, ["task", group]).withColumn("place", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def climb(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (g, place, n, digest) with ``block``, in ``above`` the digest of the node ``levels`` levels above (of the
    group's root, if that is lower), and in ``steps`` the siblings before and after in the run of each level there is."""
    rows = nodes.withColumns({"block": F.expr(f"place div {arity**levels}"), "above": F.col("digest"), "steps": F.array().cast(STEPS)}).repartition("g", "block")
    run = Window.partitionBy("g", "block", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k in range(levels):
        width = arity**k
        own, first, goes_on = F.expr(f"int(place div {width} % {arity})"), F.col("place") % width == 0, F.col("n") > width
        rows = rows.withColumn("parent", F.expr(f"place div {width * arity}")).withColumn("run", F.collect_list(F.when(first, F.col("above"))).over(run))
        step = F.struct(F.concat_ws("", F.slice("run", F.lit(1), own)).alias("before"), F.concat_ws("", F.slice("run", own + 2, F.lit(arity))).alias("after"))
        rows = rows.withColumn("steps", F.when(goes_on, F.concat("steps", F.array(step))).otherwise(F.col("steps")))
        rows = rows.withColumn("above", F.when(goes_on, sha(F.concat_ws("", "run"))).otherwise(F.col("above"))).drop("run", "parent")
    return rows


def rise(leaves: DataFrame, arity: int, levels: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """From ranked leaves (g, place, n, digest), the climbed nodes of every ``levels``-th level with the number of nodes that
    they lead to, and (g, digest) of the roots."""
    size, climbed, nodes = arity**levels, [], leaves
    while True:
        # Rows of one block repeat most of their siblings, which a compressed column stores about once.
        rows = staged(climb(nodes, arity, levels), "zstd")
        parents = rows.where(F.col("place") % size == 0)
        nodes = parents.select("g", F.col("block").alias("place"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("above").alias("digest"))
        count, widest = nodes.agg(F.count("*"), F.max("n")).first()
        climbed.append((rows, count))
        if (widest or 0) <= 1:
            return climbed, nodes.select("g", "digest")


def descend(climbed: list[tuple[DataFrame, int]], upper: DataFrame) -> DataFrame:
    """The leaves with the columns of ``upper`` (g, steps, one row a group) and, before its steps, all of their own."""
    extra = [c for c in upper.columns if c not in ("g", "steps")]
    upper = upper.select("g", F.lit(0).cast("long").alias("block"), F.col("steps").alias("more"), *extra)
    for nodes, count in reversed(climbed):
        # Compressed files hide how large the nodes are in memory, so that side is never the one to broadcast.
        sides = (nodes, F.broadcast(upper)) if count <= BROADCAST_ROWS else (nodes.hint("merge"), upper)
        whole = sides[0].join(sides[1], ["g", "block"]).withColumn("steps", F.concat("steps", "more")).drop("block", "above", "more")
        upper = whole.select("g", F.col("place").alias("block"), F.col("steps").alias("more"), *extra)
    return whole


def folded(start: Column, steps: Column) -> Column:
    """The root that ``start`` leads to when it is hashed with its siblings, level by level."""
    return F.aggregate(steps, start, lambda digest, s: sha(F.concat(s["before"], digest, s["after"])))


def manifest(rows: DataFrame, key: str, group: str, fields: list[str], keep: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row for each row: ``key``, leaf, subroot (of its group), root, steps, and the columns of ``keep``.

    ``steps`` holds the digests before and after the node in its run on each level, from the leaf's to the last one below
    the root: with ``leaf`` it proves that the row belongs to ``root`` (``folded``)."""
    if arity < 2 or levels < 1:
        raise ValueError("a tree needs runs of two or more and at least one level")
    keep = keep or {}
    kept = [value.alias(f"kept{i}") for i, value in enumerate(keep.values())]
    own = rows.select(F.col(f"`{key}`").alias("key"), group_key(F.col(f"`{group}`")).alias("g"), leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"), *kept)
    climbed, roots = rise(ranked(staged(own), "g", ["key", "digest"]), arity, levels)
    subroots = staged(roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"))
    above, _ = rise(ranked(subroots, "g", ["of"]), arity, levels)
    top = descend(above, rows.sparkSession.createDataFrame([("", [])], f"g string, steps {STEPS}"))
    top = top.select(F.col("of").alias("g"), "steps", F.col("digest").alias("subroot"), folded(F.col("digest"), F.col("steps")).alias("root"))
    whole = descend(climbed, top)
    return whole.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "steps", *[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)])


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by language, each row's proof, and whether a copy with a changed count passes it."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % EACH_TAMPERED == 0
    changed = [F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = manifest(docs, "doc_id", "lang", FIELDS, {"shown": F.when(tampered, leaf_digest(changed))})
    rows = rows.withColumn("folded_root", folded(F.coalesce("shown", "leaf"), F.col("steps")))
    proof = sha(F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"]))))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text in SQL."""
    step = "list_reduce([xor(a, b)] || range(8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: {step}), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else f"{c}::VARCHAR" for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def _tree_sql(name: str, base: str) -> str:
    return f"""{name} AS (SELECT g, i, n, 0 AS k, h FROM {base} UNION ALL
  SELECT g, i // 2, (n + 1) // 2, k + 1, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, i // 2, n, k)"""


def _steps_sql(name: str, of: str, tree: str) -> str:
    """For each node of ``of`` the siblings up to the root, marked by side, in order."""
    return f"""{name} AS (SELECT o.r, list(CASE WHEN s.h IS NULL THEN 'N' WHEN (o.i >> l.k) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.k) AS p
  FROM {of} o JOIN (SELECT DISTINCT g, k FROM {tree} WHERE n > 1) l ON l.g = o.g LEFT JOIN {tree} s ON s.g = o.g AND s.k = l.k AND s.i = xor(o.i >> l.k, 1) GROUP BY o.r)"""


OP12_SQL = f"""WITH RECURSIVE d AS (SELECT *, {_crc32("doc_id::VARCHAR")} % 7 = 0 AS t FROM documents),
e AS (SELECT doc_id, coalesce('+' || lang, '') AS g, {_leaf_sql("n_chars::VARCHAR")} AS h, {_leaf_sql("(n_chars + CAST(coalesce(t, FALSE) AS INT))::VARCHAR")} AS shown FROM d),
leaf AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM e),
{_tree_sql("low", "leaf")},
sub AS (SELECT '' AS g, g AS r, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM low WHERE n = 1),
{_tree_sql("high", "sub")},
{_steps_sql("ls", "leaf", "low")}, {_steps_sql("hs", "sub", "high")},
w AS (SELECT leaf.*, sub.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(ls.p, []::VARCHAR[]) || coalesce(hs.p, []::VARCHAR[]) AS p
  FROM leaf JOIN sub ON sub.r = leaf.g LEFT JOIN ls ON ls.r = leaf.r LEFT JOIN hs ON hs.r = leaf.g),
f AS (SELECT *, list_reduce([shown] || p, lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root FROM w)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""
