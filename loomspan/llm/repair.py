"""Repair of conversations by composing finite-state machines over (cost, label string) weights.

A conversation's rows are the input acceptor, ``edit_arcs`` the edit transducer (keep, change the role, delete, insert) and
``GRAMMAR`` the acceptor of role sequences. They are composed lazily: only pairs of (row, grammar state) that a path reaches
exist, and the shortest path is taken row by row, which is their topological order; inserts before a row are taken in layers,
as no shortest path meets a grammar state twice there. Weights are (cost, labels), lower ones first; paths of equal cost to
one state never have labels that begin each other, so an order of labels stays when both go on.

Texts are sorted twice at most and never held: rows are judged as letters (``letters``), with texts as hashes. Rows equal in
conversation, turn, role and text are counted before they are shuffled. A range sort lays each conversation's rows out over
as many tasks as they fill, and each task composes segments of ``SEGMENT`` letters for every state they may be entered in;
the segments of a conversation, one row each, are then chained from its first one. Its labels, one character a row, are the
result and so must fit a task; its texts stream through one, in order, as the digest of a whole conversation needs.

Defined results: rows of one turn come by role, then by their text's SHA-256; null roles and texts are one space; a null
conversation id is a conversation of its own; a role with another initial than s, u or a is no symbol and isn't kept. Rows
that repeat are duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import staged, table
from loomspan.llm.manifest import _crc32, group_key

SEGMENT = 512
# White space, marks that end a text, the grammar (s?(ua)+)? by state and initial, its end states, costs.
SPACE, MARKS = " \t\n\x0b\x0c\r", ".!?"
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTED = (0, 3)
RIGHT = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
CHANGE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

Weight = tuple[int, str]
Weights = dict[int, Weight]


def edit_arcs(letter: str, state: int) -> Iterator[tuple[str, int, int]]:
    """What an edit of one row leads to from a grammar state: label, next state, cost.

    A letter is the initial s, u or a, or x for any other; a capital is a truncated row; d is one that must go."""
    yield "D", state, DELETE
    if letter != "d":
        more = TRUNCATED if letter.isupper() else 0
        for symbol, to in GRAMMAR[state].items():
            if symbol == letter.lower():
                yield "K", to, more
            if symbol in ROLES:
                yield "R", to, CHANGE + more


def lower(weights: Weights, state: int, weight: Weight) -> bool:
    if state in weights and weights[state] <= weight:
        return False
    weights[state] = weight
    return True


def inserted(weights: Weights) -> Weights:
    """Closure under inserts, layer by layer."""
    out, layer = dict(weights), dict(weights)
    while layer:
        following: Weights = {}
        for state, (cost, labels) in layer.items():
            for symbol, to in GRAMMAR[state].items():
                if symbol in ROLES and lower(out, to, (cost + INSERT, labels + "I")):
                    following[to] = out[to]
        layer = following
    return out


@lru_cache(maxsize=1 << 14)
def composed(letters: str, entry: int) -> tuple[tuple[int, int, str], ...]:
    """Best (state, cost, labels) behind the rows, for each state that can be reached from ``entry``."""
    weights: Weights = {entry: (0, "")}
    for letter in letters:
        after: Weights = {}
        for state, (cost, labels) in inserted(weights).items():
            for label, to, more in edit_arcs(letter, state):
                lower(after, to, (cost + more, labels + label))
        weights = after
    return tuple((state, *weight) for state, weight in sorted(weights.items()))


KEY = ["c", "has_turn", "t", "role", "sha"]


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as KEY columns without nulls, and text."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        group_key(F.col("conv_id")).alias("c"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"), text.alias("text"),
    )


def letters(rows: DataFrame) -> DataFrame:
    """One row for each different one of ``keyed``: KEY, blank, truncated, copies, and whether it is the first of its text."""
    solid = F.rtrim("text", F.lit(SPACE))
    faults = [(solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(*MARKS)).alias("truncated")]
    kinds = rows.select(*KEY, *faults).groupBy(*KEY).agg(F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.count("*").alias("copies"))
    first = kinds.groupBy("c", "role", "sha").agg(F.min(F.struct("has_turn", "t")).alias("z")).select("c", "role", "sha", "z.has_turn", "z.t", F.lit(True).alias("first"))
    return kinds.join(first, KEY, "left").withColumn("first", F.coalesce("first", F.lit(False)))


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
SEGMENTS = pa.schema(
    [("c", pa.string()), ("has_turn", pa.bool_()), ("t", pa.int64()), ("role", pa.string()), ("sha", pa.binary()), ("task", pa.int64()), ("segment", pa.int64()), ("n", pa.int64())]
    + [(c, pa.int64()) for c in COUNTS] + [("initials", pa.list_(pa.string())), ("turns", pa.list_(pa.int64()))]
    + [("paths", pa.list_(pa.struct([("entry", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("labels", pa.string())])))]
)
SEGMENTS_SQL = f"c string, has_turn boolean, t long, role string, sha binary, task long, segment long, n long, {', '.join(f'{c} long' for c in COUNTS)}, initials array<string>, turns array<long>, paths array<struct<entry:long,state:long,cost:long,labels:string>>"


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(part, schema)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as composed segments; ``turns`` holds the first turn, the last one and how many differ."""
    task = TaskContext.get().partitionId()

    def made() -> Iterator[dict]:
        own, whole, number = None, False, 0
        for row in (r for b in batches for r in b.to_pylist()):
            if own is None or row["c"] != own["c"] or len(own["letters"]) >= SEGMENT:
                if own is not None:
                    yield finished(own, whole)
                # A conversation that begins inside this task is entered in the grammar's first state only.
                whole = own is not None and row["c"] != own["c"]
                own = {k: row[k] for k in KEY} | dict.fromkeys(COUNTS, 0) | {"task": task, "segment": number, "letters": [], "initials": [], "turns": []}
                number += 1
            take(own, row)
        if own is not None:
            yield finished(own, whole)

    def take(own: dict, row: dict) -> None:
        initial, copies = row["role"][:1], row["copies"]
        before = own["initials"][-1:]
        own["illegal"] += sum(before[0] + initial not in RIGHT for _ in before) + copies - 1  # copies meet their own initial
        own["initials"] = [*own["initials"][:1], initial] if own["initials"] else [initial, initial]
        good = row["first"] and not row["blank"]
        own["blank"] += copies if row["blank"] else 0
        own["duplicate"] += 0 if row["blank"] else copies - good
        own["truncated"] += good and row["truncated"]
        letter = initial if initial in GRAMMAR[0] or initial == "a" else "x"
        own["letters"].append((letter.upper() if row["truncated"] else letter) + "d" * (copies - 1) if good else "d" * copies)
        if row["has_turn"] and row["t"] not in own["turns"][1:2]:
            own["turns"] = [own["turns"][0], row["t"], own["turns"][2] + 1] if own["turns"] else [row["t"], row["t"], 1]

    def finished(own: dict, whole: bool) -> dict:
        text = "".join(own.pop("letters"))
        paths = [(q, *path) for q in ([0] if whole else GRAMMAR) for path in composed(text, q)]
        return own | {"n": len(text), "paths": [dict(zip(("entry", "state", "cost", "labels"), p, strict=True)) for p in paths]}

    yield from _batches(made(), SEGMENTS)


PIECES = pa.schema([*list(SEGMENTS)[:5], ("segment", pa.int64()), ("labels", pa.string()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64())])
PIECES_SQL = f"c string, has_turn boolean, t long, role string, sha binary, segment long, labels string, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's sorted segments with the labels of the best whole path; the first also has the counts."""

    def made() -> Iterator[dict]:
        whole: list[dict] = []
        for row in (r for b in batches for r in b.to_pylist()):
            if whole and row["c"] != whole[0]["c"]:
                yield from finished(whole)
                whole, weights = [], None
            if not whole:
                weights, counts, turns, last = {0: (0, "")}, dict.fromkeys(COUNTS, 0), [], None
            after: Weights = {}
            for p in row.pop("paths"):
                if p["entry"] in weights:
                    cost, text = weights[p["entry"]]
                    lower(after, p["state"], (cost + p["cost"], text + p["labels"]))
            weights = after
            ends, span = row.pop("initials"), row.pop("turns")
            counts = {c: counts[c] + row[c] for c in COUNTS}
            counts["illegal"] += last is not None and last + ends[0] not in RIGHT
            last = ends[-1]
            if span:
                turns = [turns[0], span[1], turns[2] + span[2] - (turns[1] == span[0])] if turns else span
            whole.append({k: row[k] for k in (*KEY, "segment", "n")})
            whole[0] |= {"weights": weights, "counts": counts, "turns": turns}
        if whole:
            yield from finished(whole)

    def finished(whole: list[dict]) -> Iterator[dict]:
        cost, labels = min(w for q, w in inserted(whole[0].pop("weights")).items() if q in ACCEPTED)
        turns, at = whole[0].pop("turns"), 0
        more = whole[0].pop("counts") | {"cost": cost, "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0}
        for k, row in enumerate(whole):
            end = at
            for _ in range(row.pop("n")):
                end += 1
                while labels[end - 1] == "I":
                    end += 1
            end = len(labels) if k == len(whole) - 1 else end
            yield row | {"segment": k, "labels": labels[at:end]} | (more if k == 0 else {})
            at = end

    yield from _batches(made(), PIECES)


def paths(rows: DataFrame) -> DataFrame:
    """The best path of each conversation of ``keyed`` rows, in pieces behind the rows they begin with; the first piece of a
    conversation also has gaps, blank, duplicate, truncated, illegal and cost."""
    laid = staged(letters(rows)).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    segments = laid.mapInArrow(_segments, SEGMENTS_SQL)
    return segments.repartition("c").sortWithinPartitions("c", "task", "segment").mapInArrow(_chained, PIECES_SQL)


EDITS = pa.schema([("c", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted stream of pieces of paths and of texts, as the edits of each text. Pieces come no later than their texts."""

    def made() -> Iterator[dict]:
        own, labels, at, place, state = None, "", 0, 0, 0

        def edits(row: dict | None) -> Iterator[dict]:
            """Up to the edit that takes the row; without one, what is left."""
            nonlocal at, place, state
            while at < len(labels):
                edit = labels[at]
                at += 1
                role = row["role"] if row and edit in "KD" else ROLES["u" if "u" in GRAMMAR[state] else "a"]
                yield {"c": own, "place": place, "edit": edit, "role": role, "text": "" if edit == "I" else row["text"]}
                state, place = state if edit == "D" else GRAMMAR[state][role[:1]], place + 1
                if edit != "I":
                    return

        for row in (r for b in batches for r in b.to_pylist()):
            if row["c"] != own:
                yield from edits(None)
                own, labels, at, place, state = row["c"], "", 0, 0, 0
            if row["labels"] is not None:
                labels, at = labels[at:] + row["labels"], 0
            else:
                yield from edits(row)
        yield from edits(None)

    yield from _batches(made(), EDITS, 500)


def edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """c, place, edit, role, text: every edit of every conversation of ``keyed`` rows, given ``found``, its paths.

    Rows that aren't deleted (D) are the repaired conversation. All rows of a conversation lie in one task, in order."""
    pieces = found.select(*KEY, F.lit(0).alias("kind"), "segment", "labels", F.lit(None).cast("string").alias("text"))
    texts = rows.select(*KEY, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("segment"), F.lit(None).cast("string").alias("labels"), "text")
    stream = pieces.unionByName(texts).repartition("c").sortWithinPartitions(*KEY, "kind", "segment")
    return stream.select("c", "role", "labels", "text").mapInArrow(_edited, "c string, place long, edit string, role string, text string")


DIGESTS = pa.schema([("c", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[dict]:
        own, labels, digest, some = None, [], None, False
        done = lambda: {"c": own, "audit": "".join(labels), "repaired_sha256": digest.hexdigest()}
        for row in (r for b in batches for r in b.to_pylist()):
            if row["c"] != own:
                if own is not None:
                    yield done()
                own, labels, digest, some = row["c"], [], hashlib.sha256(), False
            labels.append(row["edit"])
            if row["edit"] != "D":
                digest.update(f"{chr(10) * some}{row['role']}:{row['text']}".encode())
                some = True
        if own is not None:
            yield done()

    yield from _batches(made(), DIGESTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations``, damaged by each row's key."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages of ``conversations`` and what the cheapest repair makes of them, for each conversation there was."""
    conversations = table(spark, sf_dir, "conversations")
    rows = keyed(damaged(conversations))
    found = staged(paths(rows))
    digests = edited(rows, found).mapInArrow(_digests, "c string, audit string, repaired_sha256 string")
    counts = ["gaps", *COUNTS, "cost"]
    known = found.where("cost IS NOT NULL").select("c", *counts).join(digests, "c")
    every = conversations.select("conv_id").distinct().withColumn("c", group_key(F.col("conv_id")))
    nothing = hashlib.sha256().hexdigest()
    return every.join(known, "c", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


_INSERTS = "(0,0,'',[]), (1,1,'',[]), (2,2,'',[]), (3,3,'',[]), " + ", ".join(
    f"({q},{to},'{'I' * n}',{said})" for q, to, n, said in [(0, 2, 1, ["user:"]), (0, 3, 2, ["user:", "assistant:"]), (1, 2, 1, ["user:"]), (1, 3, 2, ["user:", "assistant:"]), (2, 3, 1, ["assistant:"]), (3, 2, 1, ["user:"])]
)
OP11_SQL = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT coalesce('+' || conv_id, '') AS c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS ini, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM d),
p AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS dup, lag(ini) OVER (PARTITION BY c ORDER BY i) AS pre FROM o),
r AS (SELECT *, NOT blank AND NOT dup AND regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS trunc FROM p),
g(q, sym, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, q2, lab, said) AS (VALUES {_INSERTS}),
arcs AS (SELECT q, sym AS ini, 'K' AS lab, 0 AS cost, q2, NULL AS role FROM g UNION ALL SELECT q, NULL, 'R', 3, q2, CASE sym WHEN 'u' THEN 'user' ELSE 'assistant' END FROM g WHERE sym <> 's' UNION ALL SELECT unnest([0, 1, 2, 3]), NULL, 'D', 4, unnest([0, 1, 2, 3]), NULL),
s AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'lab': '', 'said': []::VARCHAR[]}} AS w FROM r
UNION ALL SELECT s.c, s.i + 1, a.q2, min({{'cost': CAST(s.w.cost + 3 * len(ins.lab) + a.cost + CASE WHEN r.trunc AND a.lab <> 'D' THEN 3 ELSE 0 END AS BIGINT), 'lab': s.w.lab || ins.lab || a.lab,
    'said': s.w.said || ins.said::VARCHAR[] || CASE a.lab WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(a.role, r.role) || ':' || r.text] END}})
  FROM s JOIN r ON r.c = s.c AND r.i = s.i + 1 JOIN ins ON ins.q = s.q JOIN arcs a ON a.q = ins.q2 AND (a.lab <> 'K' OR a.ini = r.ini) AND (a.lab = 'D' OR NOT (r.blank OR r.dup)) GROUP BY s.c, s.i, a.q2),
n AS (SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (pre IS NOT NULL AND pre || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
e AS (SELECT s.c, min({{'cost': s.w.cost + 3 * len(ins.lab), 'lab': s.w.lab || ins.lab, 'said': s.w.said || ins.said::VARCHAR[]}}) AS w FROM s JOIN n ON n.c = s.c AND n.n = s.i JOIN ins ON ins.q = s.q AND ins.q2 IN (0, 3) GROUP BY s.c)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(w.cost AS BIGINT), 0) AS cost, coalesce(w.lab, '') AS audit,
  sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN n ON n.c = coalesce('+' || v.conv_id, '') LEFT JOIN e ON e.c = n.c"""
