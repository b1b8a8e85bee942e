r"""URL filters with redirect equivalence, in DataFrame operations only.

Allow and block rules of the form host/path decide the urls they fit; the longest rule wins. Pages that a redirect
(``<meta http-equiv=refresh>``) or a canonical link connects are aliases: connected components over these edges carry
block decisions to members without a rule of their own. An explicit allow anywhere in a component takes precedence over
its blocks; a component without any decision is allowed, as is a page without edges.

Nodes are host, path and query; scheme and fragment don't matter. Components come from alternating large-star and
small-star steps: each step aggregates by node before its shuffle and joins back by sort-merge, which adaptive execution
splits at hubs; edges are staged between steps, so that plans stay small, and only their number and a checksum reach the
driver. Edges of steps that are done are deleted. Pages without edges take no part.

Defined results: a null url or one without ``://`` has an empty host and path and no node; a null html has no edges; rows
that repeat are judged each for itself; a null page_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import drop, staged, table

# The rules of the query.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.char_length(url)))


def _host(rest: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def _path(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def _node(rest: Column) -> Column:
    """A 128-bit key of host, path (at least ``/``) and query."""
    path = _path(rest)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return F.unhex(F.md5(F.concat(_host(rest), F.when(path == "", "/").otherwise(path), query)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def alias_edges(pages: DataFrame) -> DataFrame:
    """a, b: the urls (without scheme) that a canonical link or a redirect connects; pages: url, html."""
    rest = _rest(F.col("url"))
    links = pages.where("url IS NOT NULL AND html IS NOT NULL").select(
        rest.alias("a"), F.expr(r"regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>', 0)").alias("tags")
    ).where("a IS NOT NULL")
    link = F.explode(F.filter("tags", lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b"))).alias("tag")
    links = links.select("a", link)
    quoted = r"(?is){}\s*=\s*(?:\"\s*([^\"]*?)\s*\"|'\s*([^']*?)\s*'|([^\s\"'>]+))"
    target = F.when(
        F.col("tag").rlike(r"(?i)^<link"), F.concat(*[F.regexp_extract("tag", quoted.format(r"\bhref"), k) for k in (1, 2, 3)])
    ).otherwise(F.regexp_extract("tag", r"(?is)\burl\s*=\s*['\"]?\s*([^\s\"'>]+)", 1))
    href = F.replace(F.regexp_replace(target, "#.*$", ""), F.lit("&amp;"), F.lit("&"))
    links = links.select("a", href.alias("h")).where("h <> ''")
    folder = F.regexp_extract(F.col("a"), r"(?s)^[^/?#]*(/(?:[^?#]*/)?)?", 1)
    host, path = _host(F.col("a")), _path(F.col("a"))
    b = (
        F.when(F.col("h").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), _rest(F.col("h")))
        .when(F.col("h").startswith("//"), F.expr("substring(h, 3)"))
        .when(F.col("h").startswith("/"), F.concat(host, "h"))
        .when(F.col("h").startswith("?"), F.concat(host, path, F.col("h")))
        .when(F.col("h").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(host, F.when(folder == "", "/").otherwise(folder), "h"))
    )
    return links.select("a", b.alias("b")).where("b IS NOT NULL")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the connected component of each node of ``edges`` (u, v)."""
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # Large star: neighbours larger than a node move to the smallest node next to it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: a node and its smaller neighbours move to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, staged(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        drop(edges.sparkSession, done, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html)."""
    rest = _rest(F.col("url"))
    rows = pages.select("page_id", _host(rest).alias("host"), _path(rest).alias("path"), _node(rest).alias("node"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"))
    edges = staged(alias_edges(pages.select("url", "html")).distinct())
    if edges.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    ends = edges.select(F.col("a").alias("x")).unionByName(edges.select(F.col("b").alias("x")))
    _, decided = rule_of(_host(F.col("x")), _path(F.col("x")), rules)
    nodes = ends.select(_node(F.col("x")).alias("node"), decided.alias("action"))
    found = components(edges.select(_node(F.col("a")).alias("u"), _node(F.col("b")).alias("v")))
    decisions = nodes.where("action IS NOT NULL").distinct().join(found, "node").groupBy("root").agg(F.min("action").alias("spread"))  # allow < block
    spread = found.join(decisions, "root").select("node", "spread")
    return rows.join(spread, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP3_SQL = r"""
WITH RECURSIVE rules(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT row_number() OVER () AS rid, page_id, html,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
tags AS (SELECT rest AS a, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE rest IS NOT NULL),
href AS (SELECT a, replace(regexp_replace(CASE WHEN regexp_matches(tag, '(?i)^<link')
            THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^\s"''>]+)', 1)
            ELSE regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?\s*([^\s"''>]+)', 1) END, '#.*$', ''), '&amp;', '&') AS h
         FROM tags WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?\s*canonical\b|\bhttp-equiv\s*=\s*["'']?refresh\b')),
e AS (SELECT a, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(h, instr(h, '://') + 3)
                     WHEN starts_with(h, '//') THEN substr(h, 3)
                     WHEN starts_with(h, '/') THEN regexp_extract(a, '^[^/?#]*') || h
                     ELSE regexp_extract(a, '^[^/?#]*') || coalesce(nullif(regexp_extract(a, '(?s)^[^/?#]*(/(?:[^?#]*/)?)?', 1), ''), '/') || h END AS b
      FROM href WHERE h <> ''),
urls AS (SELECT rest AS x FROM p UNION SELECT a FROM e UNION SELECT b FROM e),
parsed AS (SELECT x, coalesce(translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(x, '(?s)^[^/?#]*(/[^?#]*)?', 1), '') AS path,
                  regexp_extract(x, '(?s)^[^?#]*(\?[^#]*)?', 1) AS query FROM urls),
ruled AS (SELECT x, host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS node,
                 arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
          FROM parsed LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
links AS (SELECT DISTINCT ra.node AS u, rb.node AS v FROM e JOIN ruled ra ON e.a = ra.x JOIN ruled rb ON e.b = rb.x),
sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u, v FROM sym UNION SELECT r.u, b.v FROM reach r JOIN sym b ON r.v = b.u),
spread AS (SELECT r.u AS node, min(action) AS action FROM reach r JOIN ruled t ON r.v = t.node WHERE action IS NOT NULL GROUP BY r.u)
SELECT page_id, coalesce(t.host, '') AS host, coalesce(t.path, '') AS path, t.rule, coalesce(t.action, s.action, 'allow') AS verdict
FROM p LEFT JOIN ruled t ON p.rest IS NOT DISTINCT FROM t.x LEFT JOIN spread s ON t.node = s.node
"""
