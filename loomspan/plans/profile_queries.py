"""Queries of profile encoding, statistics, similarities and scores, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import scalar, similarity, vectors
from loomspan.operators import logsum, profile, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + 0.0


# The 64 components of an embedding, squared and normalised, stand for a profile column; each is compared with that of
# the next id.
P_SQL = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) / list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS p FROM embeddings"
PAIR_SQL = f"WITH c AS ({P_SQL}), j AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.p AS p, b.p AS q FROM c a JOIN c b ON b.vec_id = a.vec_id + 1)"


def columns(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", "label", vectors.squared_profile(F.col("embedding")).alias("p"))


def column_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = columns(spark, d)
    a = c.select(F.col("vec_id").alias("a_id"), "p", (F.col("vec_id") + 1).alias("b_id"))
    return a.join(c.select(F.col("vec_id").alias("b_id"), F.col("p").alias("q")), "b_id")


@query(f"""
WITH m AS (SELECT p_partkey, unnest(string_split(upper(p_name), '')) AS aa, generate_subscripts(string_split(upper(p_name), ''), 1) AS pos FROM part)
SELECT p_partkey, CAST(pos AS INT) AS pos, aa, CAST(CASE WHEN instr('{profile.MATRIX_ORDER}', aa) > 0 THEN instr('{profile.MATRIX_ORDER}', aa) - 1 ELSE 20 END AS INT) AS aa_idx
FROM m WHERE aa <> ''""")
def residue_encode(spark, d):
    return profile.residues(t(spark, d, "part"), "p_partkey", "p_name")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c""")
def symbol_background(spark, d):
    return series.shares(t(spark, d, "events"), "user_id", "event_type").withColumn("share", r(F.col("share")))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS f, count(*) OVER (PARTITION BY user_id) AS kinds FROM c)
SELECT user_id, event_type, round((1 - least(1, 1 / (1 + kinds / 1.5))) * f + least(1, 1 / (1 + kinds / 1.5)) * 0.2, 6) AS p FROM f""")
def pseudocount_mix(spark, d):
    c = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    f = c.select("user_id", "event_type", (F.col("n") / F.sum("n").over(w)).alias("f"), F.count("*").over(w).alias("kinds"))
    tau = profile.admixture(2, F.col("kinds").cast("double"))
    return f.select("user_id", "event_type", r((1 - tau) * F.col("f") + tau * 0.2).alias("p"))


@query(f"""
SELECT label, round(pow(2, sum(list_sum(list_transform(p, lambda x: CASE WHEN x > 1e-10 THEN -x * log2(x) ELSE 0 END))) / count(*)), 4) AS neff FROM ({P_SQL}) GROUP BY label""")
def effective_count(spark, d):
    return profile.effective_number(columns(spark, d), "label", "p").select("label", r(F.col("neff"), 4).alias("neff"))


@query("""
WITH v AS (SELECT vec_id, vec_id % 64 AS own, list_transform(embedding, lambda x: pow(2, -1000 * abs(CAST(x AS DOUBLE)) * 40 / 1000)) AS p FROM embeddings),
s AS (SELECT vec_id, own, p, list_sum(p) AS s FROM v)
SELECT vec_id, round(s, 5) AS row_sum, s < 20 OR s > 30 AS repaired, round(CASE WHEN s < 20 OR s > 30 THEN 1 ELSE list_max(p) END, 6) AS top FROM s""")
def profile_decode(spark, d):
    e = t(spark, d, "embeddings")
    p = e.select("vec_id", (F.col("vec_id") % 64).alias("own"), F.transform("embedding", lambda x: profile.emission(F.abs(x.cast("double")) * 1000 * 40)).alias("p"))
    s = vectors.total(F.col("p"))
    fixed = vectors.repaired(F.col("p"), F.col("own"), 20.0, 30.0)
    return p.select("vec_id", r(s, 5).alias("row_sum"), ((s < 20) | (s > 30)).alias("repaired"), r(F.array_max(fixed)).alias("top"))


@query(f"""{PAIR_SQL} SELECT a_id, b_id, round(list_inner_product(p, q), 8) AS dot, round(log2(list_inner_product(p, q)), 6) AS score FROM j""")
def profile_dot_score(spark, d):
    p, q = F.col("p"), F.col("q")
    return column_pairs(spark, d).select("a_id", "b_id", r(vectors.dot(p, q), 8).alias("dot"), r(similarity.column_score(p, q)).alias("score"))


@query(f"""{PAIR_SQL} SELECT a_id, b_id, round(ln(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * z[2] * pow(2, 6.0)))), 6) AS once,
  round(ln(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * z[2] * pow(2, 12.0)))), 6) AS twice FROM j""")
def log_odds_scores(spark, d):
    n = F.array_repeat(F.lit(6.0), 64)
    p, q = F.col("p"), F.col("q")
    return column_pairs(spark, d).select("a_id", "b_id", r(similarity.log_odds(p, q, n)).alias("once"), r(similarity.log_odds(p, q, n, 2, 0.0)).alias("twice"))


@query(f"""{PAIR_SQL}, m AS (SELECT a_id, b_id, list_transform(list_zip(p, q), lambda z: (z[1] + z[2]) / 2) AS m FROM j)
SELECT a_id, b_id, round((list_sum(list_transform(m, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) + ln(64)) / ln(64), 6) AS similarity FROM m""")
def entropy_similarity(spark, d):
    return column_pairs(spark, d).select("a_id", "b_id", r(similarity.entropy_similarity(F.col("p"), F.col("q"), 64)).alias("similarity"))


@query(f"""{PAIR_SQL}, s AS (SELECT *, list_transform(p, lambda x: log2(greatest(x, 1e-9)) + 6) AS s, list_transform(q, lambda x: log2(greatest(x, 1e-9)) + 6) AS t FROM j)
SELECT a_id, b_id, round(list_inner_product(p, t) + list_inner_product(q, s), 5) AS score,
       round(s[CAST(b_id % 64 AS INT) + 1], 5) AS s_at_b, round(t[CAST(a_id % 64 AS INT) + 1], 5) AS t_at_a FROM s""")
def bidirectional_score(spark, d):
    def log2s(c):
        return F.transform(c, lambda x: F.log2(F.greatest(x, F.lit(1e-9))))

    n = F.array_repeat(F.lit(6.0), 64)
    p, q = F.col("p"), F.col("q")
    both = similarity.bidirectional(p, log2s("p"), q, log2s("q"), n)
    at = [similarity.score_at(log2s(c), n, (F.col(i) % 64).cast("int")) for c, i in (("p", "b_id"), ("q", "a_id"))]
    return column_pairs(spark, d).select("a_id", "b_id", r(both, 5).alias("score"), r(at[0], 5).alias("s_at_b"), r(at[1], 5).alias("t_at_a"))


CODES_SQL = "SELECT DISTINCT p_name, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part"


@query(f"""
WITH n AS ({CODES_SQL}), m(x, y, s) AS (SELECT chr(97 + CAST(i AS INT)), chr(97 + CAST(j AS INT)), CASE WHEN i = j THEN 5 WHEN abs(i - j) <= 2 THEN 1 ELSE -2 END FROM range(26) a(i), range(26) b(j))
SELECT p_name, left(w1, 1) AS x, left(w2, 1) AS y, CAST(coalesce(s, 0) AS INT) AS score, CAST((ascii(left(w1, 1)) - 97) * 20 + ascii(left(w2, 1)) - 97 AS INT) AS pair_code
FROM n LEFT JOIN m ON left(w1, 1) = x AND left(w2, 1) = y""")
def substitution_lookup(spark, d):
    names = t(spark, d, "part").select("p_name").distinct().select("p_name", F.left(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(1)).alias("x"), F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(1)).alias("y"))
    grid = spark.range(26).select(F.col("id").alias("i")).crossJoin(spark.range(26).select(F.col("id").alias("j")))
    letter = lambda c: F.expr(f"char(97 + {c})")
    m = grid.select(letter("i").alias("x"), letter("j").alias("y"), F.when(F.col("i") == F.col("j"), 5).when(F.abs(F.col("i") - F.col("j")) <= 2, 1).otherwise(-2).alias("s"))
    code = ((F.ascii("x") - 97) * 20 + F.ascii("y") - 97).alias("pair_code")
    return names.join(F.broadcast(m), ["x", "y"], "left").select("p_name", "x", "y", F.coalesce("s", F.lit(0)).alias("score"), code)  # the matrix has 676 rows


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_tax > l_discount AND l_tax > l_quantity / 500 THEN 0 WHEN l_discount > l_tax AND l_discount > l_quantity / 500 THEN 1 ELSE 2 END AS class,
  round(CASE WHEN l_quantity >= 47.5 THEN 1 WHEN l_tax <= 0.01 THEN 0 ELSE l_tax END, 6) AS kept
FROM lineitem""")
def argmax3_class(spark, d):
    li = t(spark, d, "lineitem")
    kept = F.when(F.col("l_quantity") >= 47.5, 1.0).otherwise(F.get(vectors.confident(F.array(F.col("l_tax"), F.lit(0.5))), F.lit(0)))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", vectors.argmax3(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 500).alias("class"), r(kept).alias("kept"))


@query(f"""SELECT vec_id, label > 7 OR vec_id % 20 = 3 AS missing, round(CASE WHEN label > 7 OR vec_id % 20 = 3 THEN 0 ELSE list_max(p) END, 6) AS top FROM ({P_SQL})""")
def mask_vectors(spark, d):
    missing = (F.col("label") > 7) | (F.col("vec_id") % 20 == 3)
    return columns(spark, d).select("vec_id", missing.alias("missing"), r(F.array_max(profile.masked(F.col("p"), missing))).alias("top"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, least(greatest(l_extendedprice / 5000 - 5, -5), 15) AS clipped, [3, 1, -2][abs(l_linenumber % 3 - CAST(l_quantity AS INT) % 3) + 1] AS access FROM lineitem""")
def score_clip(spark, d):
    a, b = F.col("l_linenumber") % 3, F.col("l_quantity").cast("int") % 3
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", scalar.clip(F.col("l_extendedprice") / 5000 - 5, -5.0, 15.0).alias("clipped"), similarity.access_similarity(a, b).alias("access"))


@query("""SELECT event_id, user_id, coalesce(lag(event_type) OVER w = event_type AND event_type <> 'view', false) AS goes_on FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def ss_continuation(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", profile.same_state_as_before("event_type", "user_id", "event_id", "view").alias("goes_on"))


@query("""SELECT event_id, user_id, list_transform([coalesce(lag(value, 5) OVER w, 0), coalesce(lag(value, 1) OVER w, 0), value, coalesce(lead(value, 1) OVER w, 0), coalesce(lead(value, 5) OVER w, 0)], lambda x: CAST(trunc(x * 100) AS INT)) AS features,
  count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def linear_window_features(spark, d):
    near = F.count("*").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-5, 5))
    return t(spark, d, "events").select("event_id", "user_id", series.shifted("user_id", "event_id", "value", [-5, -1, 0, 1, 5]).alias("features"), near.alias("n"))


@query("""SELECT event_id, user_id, list_transform([coalesce(lag(value, 5) OVER w, 0), coalesce(lag(value, 4) OVER w, 0), coalesce(lag(value, 3) OVER w, 0), coalesce(lag(value, 2) OVER w, 0), coalesce(lag(value, 1) OVER w, 0), value, coalesce(lead(value, 1) OVER w, 0), coalesce(lead(value, 2) OVER w, 0), coalesce(lead(value, 3) OVER w, 0), coalesce(lead(value, 4) OVER w, 0), coalesce(lead(value, 5) OVER w, 0)], lambda x: CAST(trunc(x * 100) AS INT)) AS features
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def linear_window_whole(spark, d):
    """All eleven offsets -5..5 of the value; zero outside."""
    return t(spark, d, "events").select("event_id", "user_id", series.shifted("user_id", "event_id", "value", list(range(-5, 6))).alias("features"))


@query("""
WITH k AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x, i: {'i': i, 'v': CAST(trunc(CAST(x AS DOUBLE) * 1000) AS INT)}), lambda z: abs(z.v) > 100) AS f FROM embeddings)
SELECT vec_id, len(f) AS n, list_transform(f[:20], lambda z: z.i) AS idx, list_transform(f[:20], lambda z: z.v) AS val FROM k""")
def sparse_encode(spark, d):
    f = F.filter(F.transform("embedding", lambda x, i: F.struct((i + 1).cast("long").alias("i"), (x.cast("double") * 1000).cast("int").alias("v"))), lambda z: F.abs(z["v"]) > 100)
    k = t(spark, d, "embeddings").select("vec_id", f.alias("f")).withColumn("s", F.slice("f", 1, 20))
    return k.select("vec_id", F.size("f").cast("long").alias("n"), F.col("s.i").alias("idx"), F.col("s.v").alias("val"))


@query("""
WITH k AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x, i: {'i': i, 'v': CAST(trunc(CAST(x AS DOUBLE) * 1000) AS INT)}), lambda z: z.v <> 0) AS f FROM embeddings)
SELECT vec_id, len(f) AS n, list_transform(f, lambda z: z.i) AS idx, list_transform(f, lambda z: z.v) AS val FROM k""")
def sparse_encode_whole(spark, d):
    """All entries that aren't zero."""
    f = F.filter(F.transform("embedding", lambda x, i: F.struct((i + 1).cast("long").alias("i"), (x.cast("double") * 1000).cast("int").alias("v"))), lambda z: z["v"] != 0)
    k = t(spark, d, "embeddings").select("vec_id", f.alias("f"))
    return k.select("vec_id", F.size("f").cast("long").alias("n"), F.col("f.i").alias("idx"), F.col("f.v").alias("val"))


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
w(g, i, weight) AS (SELECT a.g, b.i, ((a.g * 31 + b.i * 17) % 23 - 11) / 10.0 FROM range(1, 4) a(g), range(1, 65) b(i)),
s AS (SELECT vec_id, g, 1 / (1 + exp(-sum(CAST(v AS DOUBLE) * CAST(weight AS DOUBLE)))) AS gate FROM e JOIN w ON e.i = w.i GROUP BY vec_id, g)
SELECT vec_id, round(sum(gate * (g - 2.5)), 6) AS potential FROM s GROUP BY vec_id""")
def gate_potential(spark, d):
    """Three gates over each embedding, as one projection."""
    weights = [[((g * 31 + i * 17) % 23 - 11) / 10 for i in range(1, 65)] for g in (1, 2, 3)]
    vector = F.transform("embedding", lambda x: x.cast("double"))
    return t(spark, d, "embeddings").select("vec_id", r(profile.gated(vector, weights, [g - 2.5 for g in (1, 2, 3)], 1.0)).alias("potential"))


@query("""
WITH g AS (SELECT user_id, round(avg(value), 6) AS gap FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id, round(e.value - g.gap, 6) AS potential FROM events e JOIN g ON e.user_id = g.user_id""")
def gap_potential_reuse(spark, d):
    e = t(spark, d, "events")
    g = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("gap"))
    return e.join(g, "user_id").select("event_id", "user_id", r(F.col("value") - F.col("gap")).alias("potential"))


@query("""
WITH m AS (SELECT l_orderkey, max(l_quantity) AS m FROM lineitem GROUP BY l_orderkey)
SELECT l.l_orderkey, round(max(m) + ln(sum(exp(l_quantity - m))), 6) AS lse FROM lineitem l JOIN m ON l.l_orderkey = m.l_orderkey GROUP BY l.l_orderkey""")
def log_sum_exp(spark, d):
    return logsum.log_sum_exp_by(t(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", r(F.col("lse")).alias("lse"))


@query("""
WITH h AS (SELECT o_orderkey, 0.3 * (o_totalprice / 5000 - 20) AS h, o_totalprice / 2000 AS s FROM orders)
SELECT o_orderkey, round(CASE WHEN h > 10 THEN exp(-h) ELSE 1 - exp(-exp(-h)) END, 8) AS p,
  round(CASE WHEN h > 10 THEN -h WHEN h < -2.5 THEN -exp(-exp(-h)) ELSE ln(1 - exp(-exp(-h))) END, 6) + 0 AS log_p,
  round(CASE WHEN s > 200 THEN 100 ELSE 100 / (1 + pow(sqrt(4000) * exp(-s / 5) + sqrt(0.15) * exp(-s / 68), 2)) END, 6) AS true_local,
  round(CASE WHEN s > 200 THEN 100 ELSE 100 / (1 + pow(sqrt(6000) * exp(-s / 5) + sqrt(0.1) * exp(-s / 74), 2)) END, 6) AS true_global FROM h""")
def hit_significance(spark, d):
    s, lam, mu = F.col("o_totalprice") / 5000, F.lit(0.3), F.lit(20.0)
    two = F.col("o_totalprice") / 2000
    return t(spark, d, "orders").select("o_orderkey", r(scalar.p_value(s, lam, mu), 8).alias("p"), r(scalar.log_p_value(s, lam, mu)).alias("log_p"), r(scalar.true_positive(two)).alias("true_local"), r(scalar.true_positive(two, "global")).alias("true_global"))


@query("""
SELECT l_orderkey, round(0.1 * sum(q * (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0))), 4) AS correlation FROM (
  SELECT l_orderkey, l_quantity AS q, lag(l_quantity, 1) OVER w AS a, lag(l_quantity, 2) OVER w AS b, lag(l_quantity, 3) OVER w AS c, lag(l_quantity, 4) OVER w AS e
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) GROUP BY l_orderkey""")
def neighbour_correlation(spark, d):
    found = series.neighbour_correlation(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity")
    return found.withColumn("correlation", r(F.col("correlation"), 4))


@query("""(SELECT 'down' AS way, s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rk FROM supplier QUALIFY rk <= 50)
UNION ALL (SELECT 'up', s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS INT) AS rk FROM supplier QUALIFY rk <= 50)""")
def sort_variants(spark, d):
    """The 50 first of a descending and an ascending order: top-k by partial sorts, so only those rows meet for numbering."""
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    out = None
    for way, order in (("down", [F.desc("s_acctbal"), F.col("s_suppkey")]), ("up", [F.col("s_acctbal"), F.col("s_suppkey")])):
        top = s.orderBy(*order).limit(50).select(F.lit(way).alias("way"), "s_suppkey", F.row_number().over(Window.orderBy(*order)).alias("rk"))
        out = top if out is None else out.unionByName(top)
    return out


@query("""SELECT 'down' AS way, s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rk FROM supplier
UNION ALL SELECT 'up', s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) FROM supplier""")
def sort_whole(spark, d):
    """The whole of both orders: ranges by quantiles, ranks within each, and the sizes of the ranges before it."""
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(s.approxQuantile("s_acctbal", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    v, out = F.col("s_acctbal"), None
    for way, order in (("down", [v.desc_nulls_last(), F.col("s_suppkey")]), ("up", [v.asc_nulls_last(), F.col("s_suppkey")])):
        place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x > v if way == "down" else x < v)) if bounds else F.lit(0)  # noqa: B023
        dealt = s.withColumn("part", F.when(v.isNull(), len(bounds) + 1).otherwise(place))
        sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
        before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
        rk = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
        ranked = dealt.join(F.broadcast(before), "part").select(F.lit(way).alias("way"), "s_suppkey", rk.alias("rk"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS run, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, min(run) AS chosen_run FROM c WHERE run > (l_orderkey * 7919 % 1000) / 1000.0 * total GROUP BY l_orderkey""")
def weighted_choice(spark, d):
    return series.weighted_choice(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", F.col("l_orderkey") * 7919 % 1000 / 1000.0)


@query("""
SELECT doc_id, CAST(regexp_extract(text, '-?\\d+') AS VARCHAR) AS first_number, regexp_extract(text, '\\S+') AS first_word,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS n_lines, string_split(text, '.')[1] AS head, CAST(instr(upper(text), 'HHH') AS INT) AS tag_at
FROM documents WHERE text IS NOT NULL""")
def text_section_scan(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.regexp_extract(text, r"-?\d+", 0).alias("first_number"), scalar.first_word(text).alias("first_word"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), scalar.cut_at(text, ".").alias("head"), F.instr(F.upper(text), "HHH").alias("tag_at"),
    )


@query("""
WITH u AS (SELECT page_id, string_split(url, '://')[2] AS p FROM pages)
SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(p, '([^/]*)$', 1), '\\.([^.]*)$', 1) AS ext,
  regexp_replace(p, '\\.[^./]*$', '') AS stem, regexp_extract(p, '^(.*/)?[^/]*$', 1) AS dir FROM u""")
def path_parts(spark, d):
    u = t(spark, d, "pages").select("page_id", F.split_part("url", F.lit("://"), F.lit(2)).alias("p"))
    p = F.col("p")
    return u.select("page_id", scalar.base_name(p).alias("base"), scalar.extension(p).alias("ext"), scalar.without_extension(p).alias("stem"), scalar.directory(p).alias("dir"))


def _fitted_sql(x: str, w: int) -> str:
    size, minus = f"(CASE WHEN {x} = 0 THEN '-inf'::DOUBLE ELSE log10(abs({x})) END)", f"CAST({x} < 0 AS INT)"
    digits = f"({w} - 2 - {minus} - CASE WHEN {size} > 0 THEN CAST(floor({size}) AS INT) ELSE 0 END)"
    return f"""CASE WHEN {size} >= {w} - {minus} - 1 OR -{size} > 3 THEN printf('%{w}.' || greatest({w} - 6 - {minus}, 1) || 'e', {x})
      WHEN {digits} = 0 THEN lpad(printf('%.0f', {x}) || '.', CAST(greatest({w}, length(printf('%.0f', {x})) + 1) AS INT), ' ') ELSE printf('%{w}.' || {digits} || 'f', {x}) END"""


@query(f"""SELECT c_custkey, {_fitted_sql("(c_acctbal * 1.2345678::DOUBLE)", 8)} AS wide, {_fitted_sql("(c_acctbal * 1.2345678::DOUBLE)", 5)} AS narrow, {_fitted_sql("(c_acctbal * 1.2345678::DOUBLE / 7e6)", 9)} AS small, substr(c_name, 4, 6) AS name FROM customer""")
def fitted_numbers(spark, d):
    """Numbers in a fixed width, and a part of a text."""
    x = F.col("c_acctbal") * 1.2345678
    return t(spark, d, "customer").select("c_custkey", scalar.fitted(x, 8).alias("wide"), scalar.fitted(x, 5).alias("narrow"), scalar.fitted(x / 7e6, 9).alias("small"), scalar.trimmed(F.col("c_name"), 3, 6).alias("name"))
