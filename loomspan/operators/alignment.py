"""Relational algebra of alignments: rows (pair_id, step, x, y), null for a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.profile import ALPHABETIC


def from_gapped(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows of two gapped strings of equal length; double gaps stay, with both null."""
    pairs = df.select(key, F.posexplode(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))).alias("step", "z")).where("z.a <> ''")
    w = Window.partitionBy(key).orderBy("step")

    def place(c: str) -> Column:
        on = F.col(f"z.{c}") != "-"
        return F.when(on, F.sum(on.cast("int")).over(w)).cast("int")

    return pairs.select(key, "step", place("a").alias("x"), place("b").alias("y"))


def matches(df: DataFrame) -> DataFrame:
    return df.where("x IS NOT NULL AND y IS NOT NULL")


def unaligned(df: DataFrame, key: str, side: str = "x") -> DataFrame:
    """key and the residues of one side that no match has."""
    return df.where(F.col(side).isNotNull()).select(key, side).join(matches(df).select(key, side), [key, side], "left_anti")


def signed(df: DataFrame, key: str) -> DataFrame:
    """Null coordinates as minus the last consumed index before them."""
    w = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return df.select(key, "step", *[F.coalesce(F.col(c), -F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0))).alias(c) for c in "xy"])


def canonical(pairs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A whole alignment from match rows: before each match, its gaps in x order and then in y order.

    ``pairs`` has key, lx, ly; ``found`` has key, x, y, increasing in both."""
    ends = pairs.select(key, (F.col("lx") + 1).alias("x"), (F.col("ly") + 1).alias("y"), F.lit(True).alias("end"))
    rows = found.select(key, "x", "y", F.lit(False).alias("end")).unionByName(ends)
    w = Window.partitionBy(key).orderBy("x")
    rows = rows.withColumn("px", F.coalesce(F.lag("x").over(w), F.lit(0))).withColumn("py", F.coalesce(F.lag("y").over(w), F.lit(0)))

    def run(lo: str, hi: str, side: int) -> Column:
        none = F.lit(None).cast("int")
        return F.when(F.col(hi) - F.col(lo) > 1, F.transform(F.sequence(F.col(lo) + 1, F.col(hi) - 1), lambda i: F.struct((none if side else i.cast("int")).alias("x"), (i.cast("int") if side else none).alias("y")))).otherwise(
            F.array().cast("array<struct<x:int,y:int>>")
        )

    last = F.when(F.col("end"), F.array().cast("array<struct<x:int,y:int>>")).otherwise(F.array(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))))
    parts = rows.select(key, F.col("x").alias("at"), F.posexplode(F.concat(run("px", "x", 0), run("py", "y", 1), last)).alias("k", "c"))
    return parts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at", "k")) - 1).alias("step"), "c.x", "c.y")


def gapped(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key and the two gapped strings of an alignment joined with its sequences."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("c"), F.first(a).alias("sa"), F.first(b).alias("sb"))

    def line(s: str, c: str) -> Column:
        return F.array_join(F.transform("c", lambda r: F.when(r[c].isNull(), "-").otherwise(F.substring(F.col(s), r[c], F.lit(1)))), "")

    return rows.select(key, line("sa", "x").alias(a), line("sb", "y").alias(b))


def at_target(df: DataFrame, y: Column | int) -> DataFrame:
    """Steps of an alignment at one residue of the second sequence; none where it isn't aligned or in no step."""
    return df.where(F.col("y") == y)


def blocks(found: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Ungapped runs of matches: first x, first y and length, of at least ``least``."""
    w = Window.partitionBy(key).orderBy("x")
    runs = found.withColumn("gx", F.col("x") - F.row_number().over(w)).withColumn("gy", F.col("y") - F.row_number().over(w))
    return runs.groupBy(key, "gx", "gy").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.count("*").alias("n")).where(F.col("n") >= least).select(key, "x", "y", "n")


def box(found: DataFrame, key: str, margin: int = 0) -> DataFrame:
    lo, hi = [(F.min(c) - margin).alias(f"{c}_lo") for c in "xy"], [(F.max(c) + margin).alias(f"{c}_hi") for c in "xy"]
    return found.groupBy(key).agg(*lo, *hi)


def band(df: DataFrame, key: str, near: int) -> DataFrame:
    """For each x, the y range within ``near`` of the path; rows without a y take the last one."""
    w = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    y = df.withColumn("y", F.coalesce("y", F.last("y", ignorenulls=True).over(w), F.lit(0)))
    return y.where("x IS NOT NULL").groupBy(key, "x").agg(F.greatest(F.min("y") - near, F.lit(1)).alias("lo"), (F.max("y") + near).alias("hi"))


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, common: the number of matches both alignments have; 0 where they share none."""
    both = matches(a).select(key, "x", "y").join(matches(b).select(key, "x", "y"), [key, "x", "y"]).groupBy(key).agg(F.count("*").alias("common"))
    return a.select(key).distinct().join(both, key, "left").select(key, F.coalesce("common", F.lit(0)).alias("common"))


def composed(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Matches x -> z of a: x -> y and b: y -> z."""
    return matches(a).join(matches(b).select(key, F.col("x").alias("y"), F.col("y").alias("z")), [key, "y"]).select(key, "x", F.col("z").alias("y"))


def first_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The first step at which two alignments differ; -1 where they are equal."""
    j = a.join(b.select(key, "step", F.col("x").alias("x2"), F.col("y").alias("y2")), [key, "step"], "full")
    differ = ~(F.col("x").eqNullSafe(F.col("x2")) & F.col("y").eqNullSafe(F.col("y2")))
    return j.groupBy(key).agg(F.coalesce(F.min(F.when(differ, F.col("step"))), F.lit(-1)).alias("first"))


def spliced(parts: list[DataFrame], key: str) -> DataFrame:
    """Pieces of an alignment put one after the other and numbered anew."""
    rows = None
    for k, p in enumerate(parts):
        q = p.select(key, F.lit(k).alias("part"), "step", "x", "y")
        rows = q if rows is None else rows.unionByName(q)
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part", "step")) - 1).alias("step"), "x", "y")


def extended(found: DataFrame, residues_x: DataFrame, residues_y: DataFrame, key: str, standard: str = ALPHABETIC) -> DataFrame:
    """Matches plus, at both ends of each block, the run of equal and unaligned residues on its diagonal.

    ``residues_x`` has key, x, aa, ``residues_y`` key, y, aa; unknown letters end a run. Between two blocks the first one's
    run is taken whole and the second one's as far as residues are left. Work grows with the blocks and the gaps between
    them, not with the product of both lengths."""
    inside = blocks(found, key).select(key, "x", "y", "n")
    sides = [rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(c, "aa"))).alias(c)).select(key, F.col(f"{c}.aa").alias(f"s{c}")) for c, rows in (("x", residues_x), ("y", residues_y))]
    along = Window.partitionBy(key).orderBy("x")
    first = F.lag("x").over(along).isNull()
    # Gaps: before each block, and one after the last; from the residues behind the block before to those before the next.
    gap = F.struct(F.coalesce(F.lag(F.col("x") + F.col("n")).over(along), F.lit(1)).alias("x"), F.coalesce(F.lag(F.col("y") + F.col("n")).over(along), F.lit(1)).alias("y"), F.col("x").alias("to_x"), F.col("y").alias("to_y"), (~first).alias("after"), F.lit(True).alias("before"))
    last = F.struct((F.col("x") + F.col("n")).alias("x"), (F.col("y") + F.col("n")).alias("y"), (F.size("sx") + 1).cast("long").alias("to_x"), (F.size("sy") + 1).cast("long").alias("to_y"), F.lit(True).alias("after"), F.lit(False).alias("before"))
    rows = inside.join(sides[0], key).join(sides[1], key).withColumns({"gap": gap, "end": F.lead("x").over(along).isNull()})
    kinds = "array<struct<x:bigint,y:bigint,to_x:bigint,to_y:bigint,after:boolean,before:boolean>>"
    gaps = rows.select(key, "sx", "sy", F.explode(F.when(F.col("end"), F.array("gap", last).cast(kinds)).otherwise(F.array("gap").cast(kinds))).alias("g")).select(key, "sx", "sy", "g.*")
    # Tails start side by side at the gap's front, heads at its back.
    size = F.least(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y")).cast("int")

    def cut(side: str, at: Column) -> Column:
        return F.slice(side, F.greatest(at, F.lit(1)).cast("int"), F.greatest(size, F.lit(0)))

    def run(x: Column, y: Column) -> Column:
        """How many pairs from the first on are equal and standard."""
        good = F.zip_with(x, y, lambda a, b: (a == b) & (a != "") & (F.instr(F.lit(standard), a) > 0))
        stop = F.array_position(good, F.lit(False))
        return F.when(stop > 0, stop - 1).otherwise(F.size(good)).cast("int")

    tail = F.when(F.col("after"), run(cut("sx", F.col("x")), cut("sy", F.col("y")))).otherwise(0)
    head = F.when(F.col("before"), run(F.reverse(cut("sx", F.col("to_x") - size)), F.reverse(cut("sy", F.col("to_y") - size)))).otherwise(0)
    runs = gaps.withColumns({"tail": tail, "head": head}).withColumn("head", F.least("head", size - F.col("tail")))
    ahead = F.transform(F.sequence(F.lit(0), F.col("tail") - 1), lambda k: F.struct((F.col("x") + k).alias("x"), (F.col("y") + k).alias("y")))
    behind = F.transform(F.sequence(F.lit(1), F.col("head").cast("int")), lambda k: F.struct((F.col("to_x") - k).alias("x"), (F.col("to_y") - k).alias("y")))
    none = F.array().cast("array<struct<x:bigint,y:bigint>>")
    more = F.concat(F.when(F.col("tail") > 0, ahead).otherwise(none), F.when(F.col("head") > 0, behind).otherwise(none))
    added = runs.select(key, F.explode(more).alias("c")).select(key, F.col("c.x").cast("int").alias("x"), F.col("c.y").cast("int").alias("y"))
    return found.select(key, "x", "y").unionByName(added)


def spans(df: DataFrame, key: str) -> DataFrame:
    """Steps of alignments with ``state`` (0 match, 1 gap in y, 2 gap in x), that of the step before in ``before`` (0 for the
    first), from the first match of each to its last. Steps without a residue are left out."""
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    rows = df.where(x | y).withColumn("state", F.when(x & y, 0).when(x, 1).otherwise(2))
    whole, along = Window.partitionBy(key), Window.partitionBy(key).orderBy("step")
    ends = {f: getattr(F, f)(F.when(F.col("state") == 0, F.col("step"))).over(whole) for f in ("min", "max")}
    rows = rows.withColumns({"before": F.coalesce(F.lag("state").over(along), F.lit(0)), "first_match": ends["min"], "last_match": ends["max"]})
    rows = rows.withColumn("before", F.when(F.col("step") == F.col("first_match"), 0).otherwise(F.col("before")))
    return rows.where(F.col("step").between(F.col("first_match"), F.col("last_match"))).drop("first_match", "last_match")


def rescored(steps: DataFrame, key: str, penalties: dict) -> DataFrame:
    """key, score, lali: the score anew of ``spans`` rows with their potential ``phi``, and how many residues of y they hold.

    Matches count clipped and with their penalty; a gap in y after a gap in x is free."""
    p, state, before, phi = penalties, F.col("state"), F.col("before"), F.col("phi")
    low, high = (F.lit(float(v)) for v in p["clip"])
    value = (
        F.when(state == 0, F.least(F.greatest(phi, low), high) + p["mm"]).when((state == 1) & (before == 2), 0.0)
        .when(state == 1, phi + F.when(before == 0, p["mi"]).otherwise(p["ii"])).otherwise(phi + F.when(before == 0, p["md"]).when(before == 1, p["id"]).otherwise(p["dd"]))
    )
    return steps.groupBy(key).agg((F.greatest(F.lit(0.0), F.sum(value)) / p["divisor"]).alias("score"), F.count_if(state != 1).alias("lali"))
