"""Queries of alignments: scores of name pairs, and the relational algebra of alignments read off event sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.edit import global_score
from loomspan.operators import alignment, dynamic, mapping, refine, sweeps
from loomspan.plans.profile_queries import r, t

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Two alignments for each user: events that consume x, y or both.
KINDS = {"a": (("click", "view", "purchase"), ("click", "view", "signup")), "b": (("click", "error", "purchase"), ("click", "error", "signup"))}


def _ali_sql(which: str) -> str:
    x, y = (", ".join(f"'{e}'" for e in k) for k in KINDS[which])
    w = "(PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT user_id AS pair_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, event_type, CASE WHEN event_type IN ({x}) THEN sum(CAST(event_type IN ({x}) AS INT)) OVER {w} END AS x,
      CASE WHEN event_type IN ({y}) THEN sum(CAST(event_type IN ({y}) AS INT)) OVER {w} END AS y FROM events"""


A_SQL, B_SQL = _ali_sql("a"), _ali_sql("b")
M_SQL = f"m AS (SELECT pair_id, x, y FROM ({A_SQL}) WHERE x IS NOT NULL AND y IS NOT NULL)"
MB_SQL = f"mb AS (SELECT pair_id, x, y FROM ({B_SQL}) WHERE x IS NOT NULL AND y IS NOT NULL)"


def aligned(spark: SparkSession, d: str, which: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    def place(kinds):
        on = F.col("event_type").isin(*kinds)
        return F.when(on, F.sum(on.cast("int")).over(run))

    x, y = KINDS[which]
    return t(spark, d, "events").select(F.col("user_id").alias("pair_id"), (F.row_number().over(w) - 1).alias("step"), "event_type", place(x).alias("x"), place(y).alias("y"))


NAMES_SQL = """n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM n),
c AS (SELECT DISTINCT a.p_name AS name, b.p_name AS other FROM w a JOIN w b ON a.w = b.w AND a.p_name <> b.p_name)"""


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names that share a word: the candidate list of pairs, by an equi-join on words."""
    w = t(spark, d, "part").select("p_name").distinct().select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    a, b = w.select(F.col("p_name").alias("name"), "w"), w.select(F.col("p_name").alias("other"), "w")
    return a.join(b, "w").where("name <> other").select("name", "other").distinct()


@query(f"""WITH {NAMES_SQL}, s AS (SELECT name, other, -levenshtein(name, other) AS score FROM c)
SELECT name, other, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS rk FROM s) WHERE rk = 1""")
def best_aligned_name(spark, d):
    """For each product name the other one that aligns best, by a native dynamic program."""
    s = name_pairs(spark, d).withColumn("score", global_score(F.col("name"), F.col("other"), 0.0, -1.0, -1.0))
    best = s.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("b"))
    return best.select("name", "b.other", (-F.col("b.s") + 0.0).alias("score"))


@query(f"""WITH {NAMES_SQL}, s AS (SELECT name, other, -levenshtein(name, other) AS score FROM c)
SELECT name, other, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS rk FROM s) WHERE rk <= 3""")
def top_k_hits(spark, d):
    s = name_pairs(spark, d).withColumn("score", global_score(F.col("name"), F.col("other"), 0.0, -1.0, -1.0))
    rk = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "other"))
    return s.select("name", "other", rk.alias("rk")).where("rk <= 3")


@query(f"""WITH {NAMES_SQL}, e AS (SELECT name, other, unnest(range(1, length(name) + 1)) AS x FROM c), g AS (SELECT name, other, x, unnest(range(1, length(other) + 1)) AS y FROM e),
v AS (SELECT *, CASE WHEN substr(name, CAST(x AS INT), 1) = substr(other, CAST(y AS INT), 1) THEN 10 ELSE -15 END AS s FROM g)
SELECT name, other, x, y, CAST(sum(s) OVER (PARTITION BY name, other, x - y ORDER BY x RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS diagonal FROM v""")
def diagonal_window_features(spark, d):
    g = name_pairs(spark, d).select("name", "other", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("x")).select("*", F.explode(F.sequence(F.lit(1), F.length("other"))).alias("y"))
    s = F.when(F.expr("substring(name, x, 1) = substring(other, y, 1)"), 10).otherwise(-15)
    w = Window.partitionBy("name", "other", F.col("x") - F.col("y")).orderBy("x").rangeBetween(-5, 5)
    return g.withColumn("s", s).select("name", "other", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.sum("s").over(w).alias("diagonal"))


@query(f"""SELECT pair_id, step, CAST(coalesce(x, -coalesce(last_value(x IGNORE NULLS) OVER w, 0)) AS BIGINT) AS x, CAST(coalesce(y, -coalesce(last_value(y IGNORE NULLS) OVER w, 0)) AS BIGINT) AS y
FROM ({A_SQL}) WINDOW w AS (PARTITION BY pair_id ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def alignment_signed(spark, d):
    return alignment.signed(aligned(spark, d, "a"), "pair_id").select("pair_id", F.col("step").cast("long").alias("step"), "x", "y")


@query(f"""WITH {M_SQL}, g AS (SELECT *, x - row_number() OVER (PARTITION BY pair_id ORDER BY x) AS gx, y - row_number() OVER (PARTITION BY pair_id ORDER BY x) AS gy FROM m)
SELECT pair_id, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, count(*) AS n FROM g GROUP BY pair_id, gx, gy HAVING count(*) >= 2""")
def ungapped_blocks(spark, d):
    return alignment.blocks(alignment.matches(aligned(spark, d, "a")), "pair_id", 2)


@query(f"""WITH {M_SQL}, l AS (SELECT pair_id, max(x) AS lx, max(y) AS ly FROM ({A_SQL}) GROUP BY pair_id),
gx AS (SELECT l.pair_id, i AS x FROM l, LATERAL (SELECT unnest(range(1, CAST(lx AS BIGINT) + 1)) AS i) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pair_id = l.pair_id AND m.x = i)),
gy AS (SELECT l.pair_id, i AS y FROM l, LATERAL (SELECT unnest(range(1, CAST(ly AS BIGINT) + 1)) AS i) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pair_id = l.pair_id AND m.y = i)),
e AS (SELECT pair_id, x, y FROM m UNION ALL SELECT pair_id, lx + 1, ly + 1 FROM l),
o AS (SELECT pair_id, x AS before_x, 2 AS k, x AS i, x, y FROM m
  UNION ALL SELECT gx.pair_id, (SELECT min(e.x) FROM e WHERE e.pair_id = gx.pair_id AND e.x > gx.x), 0, gx.x, gx.x, NULL FROM gx
  UNION ALL SELECT gy.pair_id, (SELECT min(e.x) FROM e WHERE e.pair_id = gy.pair_id AND e.y > gy.y), 1, gy.y, NULL, gy.y FROM gy)
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY before_x, k, i) - 1 AS INT) AS step, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM o""")
def alignment_canonical(spark, d):
    a = aligned(spark, d, "a")
    ends = a.groupBy("pair_id").agg(F.max("x").alias("lx"), F.max("y").alias("ly"))
    return alignment.canonical(ends, alignment.matches(a).select("pair_id", "x", "y"), "pair_id")


@query(f"""WITH {M_SQL} SELECT pair_id, CAST(min(x) - 3 AS BIGINT) AS x_lo, CAST(max(x) + 3 AS BIGINT) AS x_hi, CAST(min(y) - 3 AS BIGINT) AS y_lo, CAST(max(y) + 3 AS BIGINT) AS y_hi FROM m GROUP BY pair_id""")
def alignment_box(spark, d):
    f = alignment.box(alignment.matches(aligned(spark, d, "a")), "pair_id", 3)
    return f.select("pair_id", "x_lo", "x_hi", "y_lo", "y_hi")


@query(f"""WITH f AS (SELECT pair_id, x, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS y FROM ({A_SQL}))
SELECT pair_id, CAST(x AS BIGINT) AS x, CAST(greatest(min(y) - 2, 1) AS BIGINT) AS lo, CAST(max(y) + 2 AS BIGINT) AS hi FROM f WHERE x IS NOT NULL GROUP BY pair_id, x""")
def alignment_band(spark, d):
    f = alignment.band(aligned(spark, d, "a"), "pair_id", 2)
    return f.select("pair_id", "x", F.col("lo").cast("long").alias("lo"), "hi")


@query(f"""WITH {M_SQL}, {MB_SQL} SELECT m.pair_id, CAST(m.x AS BIGINT) AS x, CAST(mb.y AS BIGINT) AS y FROM m JOIN mb ON m.pair_id = mb.pair_id AND m.y = mb.x""")
def alignment_compose(spark, d):
    return alignment.composed(aligned(spark, d, "a"), aligned(spark, d, "b"), "pair_id")


@query(f"""WITH {M_SQL}, {MB_SQL}, c AS (SELECT pair_id, count(*) AS common FROM m JOIN mb USING (pair_id, x, y) GROUP BY pair_id),
na AS (SELECT pair_id, count(*) AS n FROM m GROUP BY pair_id), nb AS (SELECT pair_id, count(*) AS n FROM mb GROUP BY pair_id)
SELECT u.pair_id, coalesce(common, 0) AS common, round(coalesce(common, 0) / na.n, 6) AS recall, round(coalesce(common, 0) / nb.n, 6) AS precision
FROM (SELECT DISTINCT user_id AS pair_id FROM events) u LEFT JOIN c USING (pair_id) LEFT JOIN na USING (pair_id) LEFT JOIN nb USING (pair_id)""")
def common_pairs(spark, d):
    """Overlap with a known alignment, as a count and as precision and recall."""
    a, b = aligned(spark, d, "a"), aligned(spark, d, "b")
    both = alignment.common(a, b, "pair_id")
    count = lambda df, name: alignment.matches(df).groupBy("pair_id").agg(F.count("*").alias(name))
    j = both.join(count(a, "na"), "pair_id", "left").join(count(b, "nb"), "pair_id", "left")
    return j.select("pair_id", "common", r(F.col("common") / F.col("na")).alias("recall"), r(F.col("common") / F.col("nb")).alias("precision"))


@query(f"""WITH {M_SQL} SELECT a.pair_id, CAST(a.x AS BIGINT) AS x FROM ({A_SQL}) a WHERE a.x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.pair_id = a.pair_id AND m.x = a.x)""")
def unaligned_residues(spark, d):
    return alignment.unaligned(aligned(spark, d, "a"), "pair_id")


@query(f"""WITH a AS ({A_SQL}), b AS ({B_SQL}), j AS (SELECT pair_id, step, a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y AS same FROM a JOIN b USING (pair_id, step))
SELECT pair_id, CAST(coalesce(min(CASE WHEN NOT same THEN step END), -1) AS BIGINT) AS first FROM j GROUP BY pair_id""")
def first_difference(spark, d):
    f = alignment.first_difference(aligned(spark, d, "a"), aligned(spark, d, "b"), "pair_id")
    return f.select("pair_id", F.col("first").cast("long").alias("first"))


@query(f"""WITH s AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 0 WHEN x IS NOT NULL THEN 1 ELSE 2 END AS st, (step * 37 + pair_id * 11) % 19 / 2.0 AS phi FROM ({A_SQL}) WHERE x IS NOT NULL OR y IS NOT NULL),
l AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY pair_id ORDER BY step), 0) AS pre, min(CASE WHEN st = 0 THEN step END) OVER p AS lo, max(CASE WHEN st = 0 THEN step END) OVER p AS hi FROM s WINDOW p AS (PARTITION BY pair_id))
SELECT pair_id, round(greatest(0, sum(CASE WHEN st = 0 THEN least(greatest(phi, -5), 15) - 7 WHEN st = 1 AND pre = 2 THEN 0 WHEN st = 1 THEN phi + CASE WHEN pre = 0 THEN -3 ELSE -3.7 END
  ELSE phi + CASE pre WHEN 0 THEN -3 WHEN 1 THEN 0 ELSE -3.7 END END)) / 4.285, 6) AS score, CAST(count(*) FILTER (st <> 1) AS BIGINT) AS lali
FROM l WHERE step BETWEEN lo AND hi GROUP BY pair_id""")
def path_rescore(spark, d):
    """Score of a path's span from its first to its last match, under the penalties of template alignment."""
    steps = alignment.spans(aligned(spark, d, "a"), "pair_id").withColumn("phi", (F.col("step") * 37 + F.col("pair_id") * 11) % 19 / 2.0)
    return alignment.rescored(steps, "pair_id", dynamic.PENALTIES["template"]).withColumn("score", r(F.col("score")))


@query(f"""SELECT pair_id, string_agg(CASE WHEN x IS NULL THEN '-' ELSE left(event_type, 1) END, '' ORDER BY step) AS a, string_agg(CASE WHEN y IS NULL THEN '-' ELSE upper(left(event_type, 1)) END, '' ORDER BY step) AS b
FROM ({A_SQL}) GROUP BY pair_id""")
def gapped_strings(spark, d):
    rows = aligned(spark, d, "a")
    letter = F.left("event_type", F.lit(1))
    text = lambda c, f: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("step", f(letter).alias("s"))))), lambda z: z["s"]), "")
    texts = rows.groupBy("pair_id").agg(text("x", F.lower).alias("a"), text("y", F.upper).alias("b"))
    return alignment.gapped(rows.join(texts, "pair_id"), "pair_id", "a", "b")


@query(f"""WITH p AS (SELECT 0 AS part, pair_id, step, x, y FROM ({A_SQL}) WHERE step < 10 UNION ALL SELECT 1, pair_id, step, x, y FROM ({B_SQL}) WHERE step >= 20)
SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY part, step) - 1 AS INT) AS step, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM p""")
def alignment_splice(spark, d):
    return alignment.spliced([aligned(spark, d, "a").where("step < 10"), aligned(spark, d, "b").where("step >= 20")], "pair_id")


def _letters(a: str, b: str, match: float = 10.0, mismatch: float = -15.0) -> np.ndarray:
    return np.where(np.array(list(a))[:, None] == np.array(list(b))[None, :], match, mismatch)


def _named(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select(F.concat_ws("|", "name", "other").alias("pair_id"), "name", "other")


def _text(path: dynamic.Path) -> str:
    return "".join("MXY"[s] for s, _, _ in path)


@query()
def align_traceback(spark, d):
    """Affine alignment of residues with free ends: score, path and matches."""

    def one(a, b):
        score, path = dynamic.affine(_letters(a, b), -11.0, -1.0)
        return {"score": score, "path": _text(path), "n_match": sum(s == 0 for s, _, _ in path)}

    return dynamic.pairs_apply(_named(spark, d), one, ["name", "other"], "score double, path string, n_match long")


def _phi(a: str, b: str) -> np.ndarray:
    return dynamic.three_state(_letters(a, b, 2.0, -1.0), -2.0, -1.0, -2.0, -1.0, -1.0)


@query()
def align_local(spark, d):
    def one(a, b):
        score, path = dynamic.local_path(dynamic.THREE, _phi(a, b))
        return {"score": score, "path": _text(path)}

    return dynamic.pairs_apply(_named(spark, d), one, ["name", "other"], "score double, path string")


@query()
def posterior_alignment(spark, d):
    """Partition function, expected number of matches, and the path of largest expected accuracy."""

    def one(a, b):
        phi = _phi(a, b)
        z, post = dynamic.posterior(dynamic.THREE, phi)
        gain, path = dynamic.expected_accuracy(dynamic.THREE, post)
        return {"log_z": round(z, 6), "matches": round(float(post[0, 1:, 1:].sum()), 6), "accuracy": round(gain, 6), "path": _text(path)}

    return dynamic.pairs_apply(_named(spark, d), one, ["name", "other"], "log_z double, matches double, accuracy double, path string")


@query()
def sampled_alignment(spark, d):
    """One path for each pair, drawn by its weight, with a generator keyed by the pair."""

    def one(a, b):
        phi = _phi(a, b)
        f = dynamic.THREE.forward(phi)
        rng = np.random.Generator(np.random.MT19937([ord(c) for c in f"{a}|{b}"]))
        ends = np.exp(f[:, -1, -1] - f[:, -1, -1].max())
        path = dynamic.THREE.sample(f, phi, (int(rng.choice(3, p=ends / ends.sum())), len(a), len(b)), rng)
        return {"path": _text(path)}

    return dynamic.pairs_apply(_named(spark, d), one, ["name", "other"], "path string")


@query()
def constrained_align(spark, d):
    """Alignment under penalties and chain geometry; coordinates on a helix stand for the template's chain."""

    def one(a, b):
        at = np.arange(len(a))
        xyz = np.stack([2.3 * np.cos(1.745 * at), 2.3 * np.sin(1.745 * at), 1.5 * at], 1)
        distance = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
        match = np.tile(_letters(a, b, 14.0, -2.0), (3, 1, 1))
        known = np.array([c != " " for c in a])[:, None] & np.array([c != " " for c in b])[None]
        raw, score, path = dynamic.constrained(match, np.zeros((2, len(a))), np.zeros((3, len(b))), known, np.zeros(len(a), bool), distance)
        return {"raw": raw, "score": score, "path": _text(path)}

    return dynamic.pairs_apply(_named(spark, d), one, ["name", "other"], "raw double, score double, path string")


SYMBOLS = ["click", "error", "purchase", "signup", "view"]
MOVES = np.log2([0.95, 0.025, 0.025, 0.25, 0.75, 0.25, 0.75])


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events and the next user's, as codes: pair_id, q, t."""
    rk = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = t(spark, d, "events").withColumn("k", rk)
    code = F.array_position(F.array(*map(F.lit, SYMBOLS)), F.col("event_type")).cast("int") - 1
    users = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", code.alias("c")))), lambda z: z["c"]).alias("codes"))
    return users.select(F.col("user_id").alias("pair_id"), F.col("codes").alias("q"), (F.col("user_id") + 1).alias("next")).join(users.select(F.col("user_id").alias("next"), F.col("codes").alias("t")), "next")


def _columns(codes) -> np.ndarray:
    hot = np.eye(len(SYMBOLS))[np.asarray(codes)] * 0.8 + 0.2 / len(SYMBOLS)
    near = (hot + np.roll(hot, 1, 0) + np.roll(hot, -1, 0)) / 3
    return near / near.sum(1, keepdims=True)


def _sides(q, u) -> tuple[list[np.ndarray], ...]:
    """Columns of both sides, those of the second over the background, and their transitions by position."""
    return [_columns(z) for z in q], [_columns(z) / 0.2 for z in u], *([np.tile(MOVES, (len(z) + 1, 1)) for z in side] for side in (q, u))


@query()
def model_alignment(spark, d):
    """Two profile models, of all of each user's events and the next user's: best path, sum, posteriors, accuracy."""

    def some(q, u):
        p, s, *moves = _sides(q, u)
        out = []
        for a, b, z in zip(p, s, sweeps.align_models(p, s, *moves), strict=True):
            on = np.array([np.log2(a[x - 1] @ b[y - 1]) for st, x, y in z.path if st == 0])
            out.append({"viterbi": round(z.score, 6), "forward": round(z.total, 6), "posterior": round(z.posterior, 6), "mac": round(z.gain, 6), "n_mac": len(z.accurate), "correlation": round(dynamic.neighbour_correlation(on), 6)})
        return out

    return sweeps.in_batches(_models(spark, d), some, ["q", "t"], (F.size("q"), F.size("t")), "viterbi double, forward double, posterior double, mac double, n_mac long, correlation double")


@query()
def model_alternatives(spark, d):
    """The best three alignments of each pair of models, away from each other: local ones, and with free ends."""

    def some(q, u):
        modes = ("local", "free")
        both = dict(zip(modes, sweeps.alternatives(*_sides(q, u), 3, modes), strict=True))
        return [{"found": [{"mode": mode, "rank": k + 1, "score": round(v, 6), "n_match": sum(st == 0 for st, _, _ in path), "first": f"{path[0][1]}:{path[0][2]}", "last": f"{path[-1][1]}:{path[-1][2]}"} for mode in both for k, (v, path) in enumerate(both[mode][i])]} for i in range(len(q))]

    kind = "found array<struct<mode:string,rank:int,score:double,n_match:int,first:string,last:string>>"
    return sweeps.in_batches(_models(spark, d), some, ["q", "t"], (F.size("q"), F.size("t")), kind).select("pair_id", F.explode("found").alias("f")).select("pair_id", "f.*")


@query()
def chain_accuracy(spark, d):
    """The path of largest expected accuracy that a chain on a helix allows, for name pairs."""

    def some(names, others):
        at = [np.arange(len(a)) for a in names]
        xyz = [np.stack([2.3 * np.cos(1.745 * z), 2.3 * np.sin(1.745 * z), 1.5 * z], 1) for z in at]
        post = [dynamic.posterior(dynamic.THREE, _phi(a, b))[1][0, 1:, 1:] for a, b in zip(names, others, strict=True)]
        gains, paths = sweeps.accurate_under_chain(post, [np.zeros(len(z), bool) for z in at], xyz)
        return [{"accuracy": round(float(g), 6), "path": _text(p)} for g, p in zip(gains, paths, strict=True)]

    return sweeps.in_batches(_named(spark, d), some, ["name", "other"], (F.length("name"), F.length("other")), "accuracy double, path string", states=3)


@query()
def greedy_refine(spark, d):
    """Each name's best hit: common pairs with the affine alignment before and after greedy refinement of the local one."""

    def one(a, b):
        truth = {(x, y) for s, x, y in dynamic.affine(_letters(a, b), -11.0, -1.0)[1] if s == 0}
        phi = _phi(a, b)
        found = {(x, y) for s, x, y in dynamic.local_path(dynamic.THREE, phi)[1] if s == 0}
        return {"before": len(found & truth), "after": len(refine.refined(phi, found, truth) & truth), "truth": len(truth)}

    hits = best_aligned_name(spark, d).select(F.concat_ws("|", "name", "other").alias("pair_id"), "name", "other")
    return dynamic.pairs_apply(hits, one, ["name", "other"], "before long, after long, truth long")


@query("""WITH n AS (SELECT a.p_partkey AS pair_id, a.p_name AS a, b.p_name AS b, a.p_name || ' of ' || a.p_type AS fa, b.p_brand || ': ' || b.p_name AS fb FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
l AS (SELECT *, least(length(a), length(b)) AS n, length(fb) - length(b) AS off FROM n)
SELECT pair_id, CAST(n AS BIGINT) AS matches, repeat('-', off) || substr(fa, 1, n) || substr(fa, n + 1) || repeat('-', length(b) - n) AS a,
  substr(fb, 1, off) || substr(b, 1, n) || repeat('-', length(fa) - n) || substr(b, n + 1) AS b FROM l""")
def mapped_alignment(spark, d):
    """Alignments of neighbouring product names, carried over to longer texts that hold them."""
    part = t(spark, d, "part")
    a = part.select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("a"), F.concat("p_name", F.lit(" of "), "p_type").alias("full_a"))
    b = part.select((F.col("p_partkey") - 1).alias("pair_id"), F.col("p_name").alias("b"), F.concat("p_brand", F.lit(": "), "p_name").alias("full_b"))
    rows = a.join(b, "pair_id")
    longest = F.greatest(F.length("a"), F.length("b"))
    rows = rows.withColumns({c: F.rpad(c, longest, "-") for c in "ab"})
    steps, texts = mapping.carried(rows)
    count = alignment.matches(steps).groupBy("pair_id").agg(F.count("*").alias("matches"))
    return texts.join(count, "pair_id").select("pair_id", "matches", "a", "b")


def _letter(side: str, at: str) -> str:
    """Residues by rule: both sides repeat three letters, the second one with shifts."""
    return f"substr('ACD', CAST({at} % 3 + 1 AS INT), 1)" if side == "x" else f"substr('ACD', CAST(({at} + {at} // 7) % 3 + 1 AS INT), 1)"


@query(f"""WITH {M_SQL}, {MB_SQL}, l AS (SELECT pair_id, max(x) AS lx, max(y) AS ly FROM ({A_SQL}) GROUP BY pair_id),
k AS (SELECT *, x - row_number() OVER (PARTITION BY pair_id ORDER BY x) AS gx, y - row_number() OVER (PARTITION BY pair_id ORDER BY x) AS gy FROM m),
b AS (SELECT pair_id, min(x) AS x, min(y) AS y, count(*) AS n FROM k GROUP BY pair_id, gx, gy),
g AS (SELECT pair_id, coalesce(lag(x + n) OVER w, 1) AS fx, coalesce(lag(y + n) OVER w, 1) AS fy, x AS tx, y AS ty, lag(x) OVER w IS NOT NULL AS after, TRUE AS before FROM b WINDOW w AS (PARTITION BY pair_id ORDER BY x)
  UNION ALL SELECT pair_id, max(x + n), max(y + n), any_value(lx) + 1, any_value(ly) + 1, TRUE, FALSE FROM b JOIN l USING (pair_id) GROUP BY pair_id),
s AS (SELECT *, least(tx - fx, ty - fy) AS size FROM g),
r AS (SELECT *, CASE WHEN after THEN coalesce(list_min(list_filter(range(CAST(size AS BIGINT)), lambda i: {_letter("x", "(fx + i)")} <> {_letter("y", "(fy + i)")})), size) ELSE 0 END AS tail,
  CASE WHEN before THEN coalesce(list_min(list_filter(range(1, CAST(size AS BIGINT) + 1), lambda i: {_letter("x", "(tx - i)")} <> {_letter("y", "(ty - i)")})) - 1, size) ELSE 0 END AS head FROM s),
e AS (SELECT pair_id, fx + i AS x, fy + i AS y FROM (SELECT *, unnest(range(CAST(tail AS BIGINT))) AS i FROM r) UNION ALL SELECT pair_id, tx - i, ty - i FROM (SELECT *, unnest(range(1, CAST(least(head, size - tail) AS BIGINT) + 1)) AS i FROM r)),
a AS (SELECT pair_id, x, y FROM m UNION ALL SELECT * FROM e)
SELECT l.pair_id, (SELECT count(*) FROM a WHERE a.pair_id = l.pair_id) AS matches, (SELECT count(*) FROM m JOIN mb USING (pair_id, x, y) WHERE m.pair_id = l.pair_id) AS before, (SELECT count(*) FROM a JOIN mb USING (pair_id, x, y) WHERE a.pair_id = l.pair_id) AS after
FROM l WHERE l.pair_id IN (SELECT pair_id FROM m)""")
def mended_overlap(spark, d):
    """Alignments whose blocks go on over equal residues, and the overlap with known ones before and after."""
    a, known = aligned(spark, d, "a"), aligned(spark, d, "b")
    found = alignment.matches(a).select("pair_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    letter = lambda at: F.substring(F.lit("ACD"), (at % 3 + 1).cast("int"), F.lit(1))
    rx = a.where("x IS NOT NULL").select("pair_id", F.col("x").cast("int").alias("x"), letter(F.col("x")).alias("aa"))
    ry = a.where("y IS NOT NULL").select("pair_id", F.col("y").cast("int").alias("y"), letter(F.col("y") + F.floor(F.col("y") / 7)).alias("aa"))
    mended = alignment.extended(found, rx, ry, "pair_id")
    count = mended.groupBy("pair_id").agg(F.count("*").alias("matches"))
    overlap = [alignment.common(rows, known, "pair_id").withColumnRenamed("common", name) for rows, name in ((found, "before"), (mended, "after"))]
    return count.join(overlap[0], "pair_id").join(overlap[1], "pair_id")
