"""Queries from profile positions to cell features, potentials and alignments, with their SQL.

Fifty embeddings in a row stand for a profile; its pair is the next profile. Model weights and residue tables follow a rule
that both sides state.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.vectors import normalised
from loomspan.operators import chain, mapping, models, potentials, staging, tiles
from loomspan.operators import positions as positions_of_files
from loomspan.operators.profile import MATRIX_ORDER, neutral_ranges
from loomspan.plans.profile_queries import r, t
from loomspan.sources import text_profiles, writers

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


NULL = [2 + j / 10 for j in range(20)]
TABLES = ([(i * 37 % 101 - 50) / 25 for i in range(400)], [(i * 41 % 97 - 48) / 25 for i in range(400)])
SUBSTITUTION = [float(i * 53 % 15 - 5) for i in range(400)]
PARTS = {"p": (1, 20), "raw": (21, 20), "ss3": (41, 3), "ss8": (44, 8), "acc": (52, 3)}


def model(strength: float = 1.0) -> potentials.Model:
    """Weights by rule; ``strength`` multiplies what the gates put out."""
    k = np.arange(potentials.TRANSITIONS * potentials.WIDEST * (1 + potentials.INPUTS))
    weights = potentials.Model.of((k * 7919 % 2003 - 1001) / 10010)
    return potentials.Model(weights.outputs * strength, weights.hidden)


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding as a position; its residue is known but for each twenty-first."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    rows = t(spark, d, "embeddings").select("vec_id", squares.alias("q"))
    rows = rows.select("vec_id", *[normalised(F.slice("q", at, n)).alias(c) for c, (at, n) in PARTS.items()])

    def largest(c: str):
        return (F.array_position(c, F.array_max(c)) - 1).cast("int")

    aa = (F.col("vec_id") % 21).cast("int")
    xyz = F.array(2.3 * F.cos(1.745 * F.col("vec_id")), 2.3 * F.sin(1.745 * F.col("vec_id")), 1.5 * (F.col("vec_id") % 50))
    return rows.select(
        F.floor(F.col("vec_id") / 50).alias("profile_id"), (F.col("vec_id") % 50 + 1).cast("int").alias("pos"), aa.alias("aa_idx"), F.when(aa < 20, aa).alias("own"), "p",
        F.transform("p", lambda x: F.log2(F.greatest(x, F.lit(1e-9)))).alias("s"), "raw", largest("ss3").alias("ss"), "ss3", "ss8", "acc", largest("acc").alias("acc_class"),
        (F.col("vec_id") % 17 == 5).alias("is_missing"), F.when(F.col("vec_id") % 17 != 5, xyz).alias("ca"),
    )


def pairs(rows: DataFrame) -> DataFrame:
    ids = rows.select(F.col("profile_id").alias("template_id")).distinct()
    return ids.select(F.col("template_id").alias("pair_id"), "template_id", (F.col("template_id") + 1).alias("target_id"))


def _norm(c: str, at: int, n: int) -> str:
    return f"list_transform(q[{at}:{at + n - 1}], lambda x: x / list_sum(q[{at}:{at + n - 1}])) AS {c}"


def _trunc(x: str) -> str:
    return f"CAST(trunc(1000 * ({x})) AS BIGINT)"


def _outer(a: str, b: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: CAST(trunc(1000 * x * y) AS BIGINT))))"


POSITIONS_SQL = f"""q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS q FROM embeddings),
n AS (SELECT vec_id, {", ".join(_norm(c, at, n) for c, (at, n) in PARTS.items())} FROM q),
o AS (SELECT vec_id // 50 AS id, vec_id % 50 + 1 AS pos, vec_id % 21 AS aa, p, list_transform(p, lambda x: log2(greatest(x, 1e-9))) AS s, raw, ss3, ss8, acc,
  list_position(ss3, list_max(ss3)) - 1 AS ss, list_position(acc, list_max(acc)) - 1 AS ac FROM n)"""
MIXED = "list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2])"
NULL_SQL = "list_transform(range(20), lambda j: 2 + j / 10)"


def _log_odds(times: int, none: float) -> str:
    s = f"list_sum(list_transform(list_zip(b.p, a.p, {NULL_SQL}), lambda z: z[1] * z[2] * pow(2.0, z[3] * {times})))"
    return f"CASE WHEN {s} > 0 THEN ln({s}) ELSE {none} END"


def _features_sql(mode: str) -> str:
    """b.* is the target's side. Empty cells lie around the grid; f holds the 396 features."""
    pair = "a.aa * 20 + b.aa"
    known = "a.aa < 20 AND b.aa < 20"
    tables = ", ".join(f"CASE WHEN {known} THEN {_trunc(f'(({pair}) * {k} % {m} - {h}) / 25')} ELSE 0 END" for k, m, h in ((37, 101, 50), (41, 97, 48)))
    m5 = " + ".join(f"list_sum(list_transform(list_zip({x}.p, {y}.s, {NULL_SQL}), lambda z: z[1] * (z[2] + z[3])))" for x, y in (("b", "a"), ("a", "b")))
    if mode == "template":
        m4 = "(list_sum(list_transform(list_zip(a.p, b.p), lambda z: CASE WHEN z[1] + z[2] > 0 THEN (z[1] + z[2]) / 2 * ln((z[1] + z[2]) / 2) ELSE 0 END)) + ln(20)) / ln(20)"
        m11 = f"list_inner_product(CAST({potentials.STRUCTURE} AS DOUBLE[][])[b.ss + 1], b.ss3)"
        own = [_trunc("m2"), _trunc(f"m2 * ({m4})"), "0", _trunc(m5), _trunc(_log_odds(2, 0.0)), "1000 * CAST(a.ss = b.ss AS INT)", _trunc(m11), "1000 * [3, 1, -2][abs(a.ac - b.ac) + 1]"]
        structure = f"{_outer('a.ss3', 'b.ss3')} || list_transform(list_zip(a.ss8, b.ss8), lambda z: CAST(trunc(1000 * z[1] * z[2]) AS BIGINT)) || {_outer('a.acc', 'b.acc')}"
        raw = "list_transform(list_zip(a.raw, b.raw), lambda z: CAST(trunc(10000 * z[1] * z[2]) AS BIGINT))"
    else:
        at = [f"CASE WHEN {y}.aa < 20 THEN {_trunc(f'{x}.s[{y}.aa + 1] + 2 + {y}.aa / 10')} ELSE 0 END" for x, y in (("a", "b"), ("b", "a"))]
        blosum = f"CASE WHEN {known} THEN {_trunc(f'0.1::DOUBLE * (({pair}) * 53 % 15 - 5)')} ELSE 0 END"
        own = [_trunc("m2"), _trunc(_log_odds(2, 0.0)), _trunc(m5), *at, "0", blosum, "0"]
        structure, raw = "list_transform(range(26), lambda i: 0)", "list_transform(range(20), lambda i: 0)"
    zeros = "list_transform(range(34), lambda i: CAST(0 AS BIGINT))"
    slot = "near" if mode == "template" else "v[3]"
    shifted = {k: f"coalesce({'lead' if k > 0 else 'lag'}(v, {abs(k)}) OVER d, {zeros})" if k else "v" for k in range(-5, 6)}
    near = "CAST(trunc(1000 * (m2 + coalesce(lag(m2) OVER d, 0) + coalesce(lead(m2) OVER d, 0))) AS BIGINT)"
    window = "WINDOW d AS (PARTITION BY pair_id, x - y ORDER BY x)"
    return f"""{POSITIONS_SQL}, l AS (SELECT id, max(pos) AS len FROM o GROUP BY id),
g AS (SELECT a.id AS pair_id, i.i AS x, j.j AS y FROM l a JOIN l b ON b.id = a.id + 1, LATERAL (SELECT unnest(range(0, a.len + 2)) AS i) i, LATERAL (SELECT unnest(range(0, b.len + 2)) AS j) j),
i AS (SELECT g.*, a.id IS NOT NULL AND b.id IS NOT NULL AS inside, a, b FROM g LEFT JOIN o a ON a.id = g.pair_id AND a.pos = g.x LEFT JOIN o b ON b.id = g.pair_id + 1 AND b.pos = g.y),
m AS (SELECT *, CASE WHEN inside THEN {_log_odds(1, -10.0)} ELSE 0 END AS m2 FROM i),
c AS (SELECT pair_id, x, y, inside, m2, CASE WHEN inside THEN [{", ".join(own)}] || {structure} ELSE {zeros} END AS v, CASE WHEN inside THEN {raw} END AS raw, CASE WHEN inside THEN [{tables}] END AS tab FROM m),
e AS (SELECT *, {near} AS near FROM c {window}),
k AS (SELECT * REPLACE (v[1:2] || [{slot}] || v[4:34] AS v) FROM e),
w AS (SELECT pair_id, x, y, inside, raw, tab, {", ".join(f"{s} AS w{k + 5}" for k, s in shifted.items())} FROM k {window}),
f AS (SELECT pair_id, x, y, raw || {" || ".join(f"w{k}[1:8]" for k in range(11))} || tab || {" || ".join(f"w{k}[9:34]" for k in range(11))} AS f FROM w WHERE inside)"""


DIGEST_SQL = """SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(len(list_filter(f, lambda v: v <> 0)) + 1 AS INT) AS n_entries, CAST(list_sum(f) AS BIGINT) AS total,
  CAST(list_sum(list_transform(f, lambda v, i: v * i)) AS BIGINT) AS by_place FROM f"""


def digest(f: np.ndarray) -> list[np.ndarray]:
    """Number of sparse entries, sum, and sum by place of each cell's features; all are whole numbers."""
    return [((f != 0).sum(1) + 1).astype(np.int32), f.sum(1).astype(np.int64), (f @ np.arange(1.0, f.shape[1] + 1)).astype(np.int64)]


def digested(rows: DataFrame, similarity: tiles.Similarity) -> DataFrame:
    return tiles.of_features(pairs(rows), rows, rows, similarity, digest, "n_entries int, total bigint, by_place bigint")


@query(f"WITH {_features_sql('template')} {DIGEST_SQL}")
def template_cell_features(spark, d):
    return digested(positions(spark, d), tiles.similarity_of(NULL, TABLES))


@query(f"WITH {_features_sql('target')} {DIGEST_SQL}")
def target_cell_features(spark, d):
    return digested(positions(spark, d), tiles.similarity_of(NULL, TABLES, "target", SUBSTITUTION))


def _weight(k: str) -> str:
    return f"((({k}) * 7919) % 2003 - 1001) / 10010"


def _potential_sql(m: int, scale: float, size: int) -> str:
    """The weighted sum of gates of transition ``m`` over the list f with its bias in front."""
    gates = potentials.GATES.get(m, potentials.OTHER_GATES)
    return f"""list_sum(list_transform(range({gates}), lambda g: {_weight(f"{m * potentials.WIDEST} + g")} /
      (1 + exp(-{scale}::DOUBLE * list_inner_product([CAST(1 AS DOUBLE)] || CAST(f AS DOUBLE[]), list_transform(range({size + 1}), lambda i: {_weight(f"{potentials.TRANSITIONS * potentials.WIDEST} + ({m * potentials.WIDEST} + g) * {potentials.INPUTS} + i")}))))))"""


@query(f"""WITH {_features_sql('template')} SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {", ".join(f"round({_potential_sql(m, potentials.MATCH_SCALE, 396)}, 6) AS {c}" for c, m in potentials.MATCH.items())} FROM f""")
def match_potentials(spark, d):
    rows = positions(spark, d)
    found = tiles.cell_potentials(pairs(rows), rows, rows, tiles.Scoring(model(), NULL, TABLES))
    return found.select("pair_id", "x", "y", *[r(F.col(c)).alias(c) for c in potentials.MATCH])


_CLASSES = "list_transform(ss3 || ss8 || acc, lambda x: CAST(trunc(100 * x) AS BIGINT))"
_ALONG = " || ".join(f"coalesce({'lead' if k > 0 else 'lag'}(c, {abs(k)}) OVER w, list_transform(range(14), lambda i: CAST(0 AS BIGINT)))" if k else "c" for k in range(-5, 6))


@query(f"""WITH {POSITIONS_SQL}, c AS (SELECT id, pos, list_transform(raw, lambda x: CAST(trunc(100 * x) AS BIGINT)) AS raw, {_CLASSES} AS c FROM o),
f AS (SELECT id, pos, raw || {_ALONG} AS f FROM c WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id AS profile_id, CAST(pos AS INT) AS pos, {", ".join(f"round({_potential_sql(m, potentials.GAP_SCALE, 174)}, 6) AS {c}" for c, m in (potentials.TEMPLATE_GAPS | potentials.TARGET_GAPS).items())} FROM f""")
def gap_potentials(spark, d):
    rows = positions(spark, d)
    both = potentials.TEMPLATE_GAPS | potentials.TARGET_GAPS
    return potentials.potentials(potentials.gap_features(rows), model(), both, potentials.GAP_SCALE).select("profile_id", "pos", *[r(F.col(c)).alias(c) for c in both])


@query()
def template_alignment(spark, d):
    """From positions through potentials to the mended alignment under the template's chain, scored anew."""
    rows = staging.checkpointed(positions(spark, d))
    scores, steps = chain.aligned(pairs(rows), rows, rows, tiles.Scoring(model(35.0), NULL, TABLES))
    texts = chain.fasta(steps, chain.sequences(pairs(rows), rows, rows)).select("pair_id", "a", "b")
    return scores.withColumns({"raw": r(F.col("raw")), "score": r(F.col("score"))}).join(texts, "pair_id", "left")


@query()
def searched_alignment(spark, d):
    """The chained program: overlap with a known alignment before and after the greedy search towards it.

    Known are matches along a diagonal that the pair's number shifts, but for each eleventh residue."""
    rows = staging.checkpointed(positions(spark, d))
    own = pairs(rows)
    shift = F.pmod(F.col("pair_id"), F.lit(5)) - 2
    known = own.join(rows.select(F.col("profile_id").alias("template_id"), F.col("pos").alias("x")), "template_id").where("x % 11 <> 0").select("pair_id", "x", (F.col("x") + shift).cast("int").alias("y"))
    known = known.join(own.join(rows.select(F.col("profile_id").alias("target_id"), F.col("pos").alias("y")), "target_id").select("pair_id", "y"), ["pair_id", "y"])
    found = chain.run(own, rows, rows, tiles.Scoring(model(35.0), NULL, TABLES), staging.checkpointed(known))
    return found.overlap.join(found.scores.select("pair_id", r(F.col("score")).alias("score"), "lali"), "pair_id")


STATE_LETTERS = "HGIEBTSL"
BACKGROUND = [(3 + j % 4) / 89 for j in range(20)]
EXCHANGE = [[0.62 if a == b else 0.02 for b in range(20)] for a in range(20)]
# Milli-bits of the transitions of a position, and thousandths of its effective numbers, as functions of the position.
MOVE_RULES = ["100 + pos * 7 % 50", "4000 + pos * 13 % 500", "4200 + pos * 11 % 400", "900 + pos * 5 % 70", "1100 + pos * 3 % 70", "1000 + pos * 17 % 90", "1200 + pos * 19 % 60"]
NEFF_RULES = ["CASE WHEN pos % 9 = 4 THEN 0 ELSE 3000 + pos * 29 % 700 END", "1000 + pos * 31 % 200", "800 + pos * 37 % 300"]
LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def models_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings' profiles as model files, written and read again, and made ready."""
    rows = positions(spark, d).select(F.col("profile_id").cast("string").alias("name"), "pos", F.transform("p", lambda x: F.when(x > 0, F.round(-1000 * F.log2(x)))).alias("emissions"), F.coalesce(F.substring(F.lit(LETTERS), F.col("own") + 1, F.lit(1)), F.lit("X")).alias("aa"))
    start = rows.select("name").distinct().select("name", F.lit(0).alias("pos"), F.array().cast("array<double>").alias("emissions"), F.lit("").alias("aa"))
    moves, neffs = (F.array(*[F.expr(f"CAST({k} AS DOUBLE)") for k in rules]) for rules in (MOVE_RULES, NEFF_RULES))
    whole = rows.unionByName(start).select("name", "aa", F.struct("pos", "emissions", moves.alias("transitions"), neffs.alias("neffs")).alias("c"))
    whole = whole.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("c.pos", "aa"))).alias("letters"), F.array_sort(F.collect_list("c")).alias("columns"))
    null = F.array(*[F.lit(float(round(-1000 * np.log2(b)))) for b in BACKGROUND])
    path = staging.shared_path(spark, "models")
    writers.write_models(whole.select("name", F.array_join("letters.aa", "").alias("sequence"), null.alias("null"), "columns"), path)
    records = text_profiles.model_records(spark, path)
    tags = records.select("name", F.explode(neutral_ranges(F.col("sequence"))).alias("z")).select("name", F.get("z", F.lit(0)).alias("first"), F.get("z", F.lit(1)).alias("last"))
    return models.prepared(text_profiles.model_columns(records), EXCHANGE, models.Pseudocounts(), tags)


def _prepared_sql() -> str:
    """m: positions 0 to length + 1 with p, pav and transitions, from the embeddings without any file."""
    null = f"list_transform([{', '.join(str(float(round(-1000 * np.log2(b)))) for b in BACKGROUND)}], lambda x: pow(2.0, -x / 1000))"
    moves, neffs = (f"[{', '.join(f'({k})::DOUBLE' for k in rules)}]" for rules in (MOVE_RULES, NEFF_RULES))
    off, stay = 0.15 * 0.0286, 1 / (1 / 0.75)
    inner, last = "pos BETWEEN 1 AND len", "pos = len"
    two = lambda k: f"pow(2.0, -tr[{k}] / 1000)"
    m = [f"(n[1] - 1) * {two(1)} + {1 - 2 * off}", f"CASE WHEN pos = 0 OR {last} THEN 0 ELSE (n[1] - 1) * {two(2)} + {off} END", f"CASE WHEN pos = 0 OR {last} THEN 0 ELSE (n[1] - 1) * {two(3)} + {off} END"]
    i = [f"n[2] * {two(4)} + {1 - stay}", f"n[2] * {two(5)} + {stay}"]
    dd = [f"n[3] * {two(6)} + {1 - stay}", f"CASE WHEN {last} THEN 0 ELSE n[3] * {two(7)} + {stay} END"]
    share = lambda part, k, scale: f"CASE WHEN ({part[k]}) > 0 THEN log2(({part[k]}) / ({' + '.join(f'({z})' for z in part)})) ELSE -100000.0 END * {scale}"
    out = [share(m, 0, 1), share(m, 1, 0.6), share(m, 2, 0.6), share(i, 0, 1), share(i, 1, 0.6), share(dd, 0, 1), share(dd, 1, 0.6)]
    return f"""{POSITIONS_SQL}, b AS (SELECT id, max(pos) AS len FROM o GROUP BY id),
a AS (SELECT b.id, b.len, k.pos, list_transform(o.p, lambda x: CASE WHEN x > 0 THEN pow(2.0, -round(-1000 * log2(x)) / 1000) ELSE 0 END) AS f FROM b, LATERAL (SELECT unnest(range(0, b.len + 2)) AS pos) k LEFT JOIN o ON o.id = b.id AND o.pos = k.pos),
c AS (SELECT *, {moves} AS tr, {neffs} AS n0, {null} AS pb FROM a),
d AS (SELECT *, CASE WHEN pos > len THEN [1.0, 0.0, 0.0] ELSE [CASE WHEN {inner} AND n0[1] = 0 THEN 1.0 ELSE n0[1] / 1000 END, n0[2] / 1000, n0[3] / 1000] END AS n FROM c),
e AS (SELECT *, CASE WHEN {inner} THEN list_transform(f, lambda x: (1 - least(1.0, 1 / (1 + n[1] / 1.5))) * x + least(1.0, 1 / (1 + n[1] / 1.5)) * (0.6 * x + 0.02 * list_sum(f))) END AS p0 FROM d),
s AS (SELECT id, avg(n[1]) AS neff, [{", ".join(f"sum(p0[{k + 1}])" for k in range(20))}] AS s, any_value(pb) AS pb FROM e WHERE {inner} GROUP BY id),
v AS (SELECT id, neff, list_transform(list_zip(s, pb), lambda z: 100 * z[2] / neff + z[1]) AS raw FROM s),
w AS (SELECT id, neff, list_transform(raw, lambda x: x / list_sum(raw)) AS pav FROM v),
m AS (SELECT e.id, e.pos, e.len, coalesce(p0, w.pav) AS p, w.pav, w.neff, CASE WHEN e.pos <= len THEN [{", ".join(out)}] END AS moves FROM e JOIN w USING (id))"""


def _by_place(z: str) -> str:
    return f"round(list_sum(list_transform({z}, lambda x, i: x * i)), 6)"


@query(f"""WITH {_prepared_sql()} SELECT CAST(id AS VARCHAR) AS name, CAST(pos AS INT) AS pos, round(neff, 6) AS neff, {_by_place("p")} AS p, {_by_place("pav")} AS pav, {_by_place("moves")} AS moves FROM m""")
def prepared_models(spark, d):
    """Models written as files and read again: emissions with pseudocounts, averages and transitions, by position."""
    summed = lambda c: r(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x))
    return models_from_files(spark, d).select("name", "pos", r(F.col("neff")).alias("neff"), summed("p").alias("p"), summed("pav").alias("pav"), summed("transitions").alias("moves"))


@query(f"""WITH {_prepared_sql()}, z AS (SELECT q.id AS pair_id, t.pos, list_transform(list_zip(t.p, q.pav, t.pav), lambda z: CASE WHEN z[2] + z[3] > 0 THEN z[1] / ((z[2] + z[3]) / 2) ELSE 0 END) AS s FROM m q JOIN m t ON t.id = q.id + 1 AND q.pos = 0)
SELECT CAST(pair_id AS VARCHAR) AS pair_id, CAST(pos AS INT) AS pos, {_by_place("s")} AS s FROM z""")
def null_divided_models(spark, d):
    """The next model's columns over the mean of both models' averages."""
    ready = models_from_files(spark, d)
    pairs = ready.where("pos = 0").select(F.col("name").alias("pair_id"), F.col("name").alias("query"), (F.col("name").cast("long") + 1).cast("string").alias("template"))
    summed = F.aggregate(F.transform("s", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return models.over_null(pairs, ready, BACKGROUND).select("pair_id", "pos", r(summed).alias("s"))


@query()
def model_file_alignment(spark, d):
    """From model files to alignments: each model and the next one, with transitions by position."""
    ready = staging.checkpointed(models_from_files(spark, d))
    pairs = ready.where("pos = 0").select(F.col("name").alias("pair_id"), F.col("name").alias("query"), (F.col("name").cast("long") + 1).cast("string").alias("template"))
    return models.aligned(pairs, ready, BACKGROUND).withColumns({c: r(F.col(c)) for c in ("score", "total", "posterior", "gain")})


_XYZ = "[2.3 * cos(1.745 * vec_id), 2.3 * sin(1.745 * vec_id), 1.5 * (vec_id % 50)]"


@query(f"""WITH p AS (SELECT vec_id // 50 AS id, vec_id % 50 + 1 AS pos, {_XYZ} AS c FROM embeddings WHERE vec_id % 17 <> 5),
d AS (SELECT a.id AS profile_id, a.pos AS i, b.pos AS j, sqrt(pow(a.c[1] - b.c[1], 2) + pow(a.c[2] - b.c[2], 2) + pow(a.c[3] - b.c[3], 2)) AS distance FROM p a JOIN p b ON a.id = b.id AND a.pos < b.pos)
SELECT profile_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(distance, 6) AS distance FROM d WHERE distance < 8""")
def chain_contacts(spark, d):
    """Residues of a profile's chain that are nearer than 8."""
    return mapping.contacts(positions(spark, d), "profile_id", "pos", "ca", 8.0).withColumn("distance", r(F.col("distance")))


def file_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions with what files hold: letters, milli-bits, and numbers that follow the position."""
    rows = positions(spark, d).drop("own")
    moves, neffs = (F.array(*[F.expr(f"CAST({k} AS DOUBLE)") for k in rules]) for rules in (MOVE_RULES, NEFF_RULES))
    letter = F.when(F.col("aa_idx") < 20, F.substring(F.lit(MATRIX_ORDER), F.col("aa_idx") + 1, F.lit(1))).otherwise("X")
    state = F.substring(F.lit(STATE_LETTERS), (F.array_position("ss8", F.array_max("ss8"))).cast("int"), F.lit(1))
    return rows.withColumns({
        "aa": letter, "ss8_letter": state, "ca_contact": F.col("pos") % 21, "cb_contact": (F.col("pos") + 7) % 21, "cb": F.transform("ca", lambda x: x + 1), "disorder": (F.col("pos") % 10) / 25,
        "emissions": F.transform("p", lambda x: F.when(x > 0, F.round(-1000 * F.log2(x)))), "transitions": moves, "neffs": neffs,
    })


_SMOOTH = [2.0**-n for n in NULL]
_MILLI = "list_transform(p, lambda x: CASE WHEN x > 0 THEN pow(2.0, -round(-1000 * log2(x)) / 1000) ELSE 0 END)"
_WITH_NEFF = f"a AS (SELECT *, {_MILLI} AS f, ({NEFF_RULES[0]}) / 1000 AS neff FROM o)"
_P = f"list_transform(list_zip(f, [{', '.join(map(str, _SMOOTH))}]), lambda z: ((neff - 1) * z[1] + 10 * (0.6 * z[1] + 0.02 * list_sum(f)) * z[2]) / (neff + 9))"


@query(f"""WITH {POSITIONS_SQL}, {_WITH_NEFF}, s AS (SELECT *, list_position(ss8, list_max(ss8)) - 1 AS k, (id * 50 + pos - 1) % 17 = 5 AS gone FROM a)
SELECT CAST(id AS VARCHAR) AS profile_id, CAST(pos AS INT) AS pos, CAST(aa AS INT) AS aa_idx, gone AS is_missing, CAST(CASE k WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INT) AS ss,
  CAST(CASE WHEN gone OR aa = 20 THEN -1 WHEN k = 0 THEN 1 WHEN k = 3 THEN 2 ELSE 0 END AS INT) AS class3, CAST(ac AS INT) AS acc_class, CASE WHEN NOT gone THEN round(round(2.3 * cos(1.745 * (id * 50 + pos - 1)), 6), 4) END AS ca_x, {_by_place("f")} AS raw, {_by_place(_P)} AS p FROM s""")
def template_files(spark, d):
    """Template files written from the embeddings and read again: features, classes, smoothed profile."""
    path = staging.shared_path(spark, "templates")
    writers.write_profiles(writers.template_text(file_positions(spark, d)), path)
    rows = text_profiles.lines(spark, path)
    got = positions_of_files.template_positions(text_profiles.template_features(rows), text_profiles.profile_columns(rows), EXCHANGE, NULL)
    summed = lambda c: r(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x))
    return got.select("profile_id", F.col("pos").cast("int").alias("pos"), "aa_idx", "is_missing", "ss", (F.array_position("ss3", F.lit(1.0)).cast("int") - 1).alias("class3"), "acc_class", r(F.get("ca", F.lit(0)), 4).alias("ca_x"), summed("raw").alias("raw"), summed("p").alias("p"))


_SIX = "list_transform({0}, lambda x: round(x, 6))"


@query(f"""WITH {POSITIONS_SQL}, {_WITH_NEFF}, s AS (SELECT *, {_SIX.format("ss3")} AS a3, {_SIX.format("acc")} AS b3, (pos % 10) / 25 > 0.2 AS off FROM a),
k AS (SELECT *, CASE WHEN list_max(b3) >= 0.95 THEN list_transform(b3, lambda x, i: CASE WHEN i = list_position(list_transform(b3, lambda y: y >= 0.95), TRUE) THEN 1.0 ELSE 0.0 END) ELSE list_transform(b3, lambda x: CASE WHEN x <= 0.01 THEN 0 ELSE x END) END AS c3 FROM s)
SELECT CAST(id AS VARCHAR) AS profile_id, CAST(pos AS INT) AS pos, CAST(aa AS INT) AS aa_idx, CAST(CASE WHEN a3[1] > a3[2] AND a3[1] > a3[3] THEN 0 WHEN a3[2] > a3[1] AND a3[2] > a3[3] THEN 1 ELSE 2 END AS INT) AS ss,
  CASE WHEN off THEN 0 ELSE {_by_place("a3")} END AS ss3, CASE WHEN off THEN 0 ELSE {_by_place("c3")} END AS acc, CAST(CASE WHEN c3[1] > c3[2] AND c3[1] > c3[3] THEN 0 WHEN c3[2] > c3[1] AND c3[2] > c3[3] THEN 1 ELSE 2 END AS INT) AS acc_class, {_by_place(_P)} AS p FROM k""")
def target_files(spark, d):
    """Target files written from the embeddings and read again: predicted classes without disordered places, profile."""
    path = staging.shared_path(spark, "targets")
    writers.write_profiles(writers.target_text(file_positions(spark, d)), path)
    rows = text_profiles.lines(spark, path)
    got = positions_of_files.target_positions(text_profiles.target_features(rows), text_profiles.profile_columns(rows), text_profiles.disorder(rows), EXCHANGE, NULL)
    summed = lambda c: r(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x))
    return got.select("profile_id", F.col("pos").cast("int").alias("pos"), "aa_idx", "ss", summed("ss3").alias("ss3"), summed("acc").alias("acc"), "acc_class", summed("p").alias("p"))
