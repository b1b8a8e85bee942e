"""Repair of conversations against a plain search over all edits."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.llm import repair

COST = {"K": 0, "R": 3, "D": 4, "I": 3}
SCHEMA = "conv_id long, turn long, role string, text string, kind string, c string, labels string"


def judged(rows):
    """Sorted rows of one conversation with their first fault, and the counts."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).digest()))
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    counts = [sum(f == k for _, _, f in out) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    return out, [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal]


def options(role, fault):
    yield "D", None, 4
    if fault not in ("blank", "duplicate"):
        more = 3 if fault else 0
        yield "K", role, more
        yield from (("R", r, 3 + more) for r in ("user", "assistant"))


def right(roles):
    return re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] if r[:1] else "?" for r in roles)) is not None


def every(rows):
    """The cheapest and least labels over all edits of a few rows, with up to two inserts at each place."""
    inserts = [tuple(p) for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(*[list(options(r, f)) for r, _, f in rows]):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            said, labels, cost = [], "", 0
            for k, put in enumerate(places):
                said += [(r, "") for r in put]
                labels, cost = labels + "I" * len(put), cost + 3 * len(put)
                if k < len(rows):
                    label, role, more = edits[k]
                    labels, cost = labels + label, cost + more
                    said += [] if role is None else [(role, rows[k][1])]
            if (best is None or (cost, labels) < best[:2]) and right([r for r, _ in said]):
                best = (cost, labels, said)
    return best


def digest(said):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def by_letters(rows):
    """The same for long ones: whole label strings by grammar state, row by row."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    at = {0: (0, "", ())}

    def closed(at):
        for _ in range(3):
            for q, (cost, labels, said) in list(at.items()):
                for r in ("user", "assistant"):
                    if (q, r[0]) in step:
                        to, new = step[q, r[0]], (cost + 3, labels + "I", (*said, (r, "")))
                        at[to] = min(at.get(to, new), new, key=lambda z: z[:2])
        return at

    for role, text, fault in rows:
        new = {}
        for q, (cost, labels, said) in closed(at).items():
            for label, r, more in options(role, fault):
                to = q if r is None else step.get((q, r[:1]))
                if to is not None:
                    z = (cost + more, labels + label, said if r is None else (*said, (r, text)))
                    new[to] = min(new.get(to, z), z, key=lambda w: w[:2])
        at = new
    return min((z for q, z in closed(at).items() if q in (0, 3)), key=lambda z: z[:2])


def found(spark, rows):
    df = repair.keyed(spark.createDataFrame([(c, t, r, x, "k", "c", "l") for c, t, r, x in rows], SCHEMA))
    paths = repair.paths(df).cache()
    counts = {r.c: [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost] for r in paths.where("cost IS NOT NULL").collect()}
    edits = {}
    for r in repair.edited(df, paths).collect():
        edits.setdefault(r.c, []).append((r.place, r.edit, r.role, r.text))
    digests = {r.c: (r.audit, r.repaired_sha256) for r in repair.edited(df, paths).mapInArrow(repair._digests, "c string, audit string, repaired_sha256 string").collect()}
    return counts, {c: sorted(e) for c, e in edits.items()}, digests


def compare(spark, rows, solve):
    counts, edits, digests = found(spark, rows)
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault("" if c is None else f"+{c}", []).append((t, r, x))
    assert set(counts) == set(groups)
    for c, own in groups.items():
        marked, want = judged(own)
        cost, labels, said = solve(marked)
        assert counts[c] == [*want, cost]
        assert "".join(e for _, e, _, _ in edits[c]) == labels
        assert [(r, x) for _, e, r, x in edits[c] if e != "D"] == list(said)
        assert digests[c] == (labels, digest(said))


def made(rng, n):
    texts = ["Yes.", "No!", "And then", "", " \t", "Why?", "Yes. ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    return [(rng.choice([0, 1, 2, 3, 7, None]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_all_edits(spark):
    rng = random.Random(3)
    rows = [(c, *row) for c in range(40) for row in made(rng, rng.randint(1, 3))]
    compare(spark, rows, every)


@pytest.mark.parametrize("segment", [1, 5, 512])
def test_long_conversations(spark, monkeypatch, segment):
    """Conversations over several tasks and segments, with many equal rows."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = []
    for c, n in ((1, 300), (2, 7), (None, 40), (3, 1)):
        role = itertools.cycle(["user", "assistant"])
        rows += [(c, k if rng.random() < 0.9 else None, next(role) if rng.random() < 0.8 else rng.choice(["user", "system", "tool"]), f"Turn {k}{rng.choice('.!?x')}" if rng.random() < 0.7 else rng.choice(["", "Again."])) for k in range(n)]
    rows += [(2, 3, "user", "Again.")] * 50
    compare(spark, rows, by_letters)


def test_no_rows(spark):
    assert found(spark, []) == ({}, {}, {})


def test_damage(spark, tmp_path):
    """All rows of a conversation dropped: zeros; nulls are one space; the key's checksum decides."""
    drops = [t for t in range(400) if repair_kind(5, t) == 0][:2]
    rows = [(5, t, "user", "Hello.") for t in drops] + [(6, None, None, None), (None, 1, "user", "Hello.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {5, 6, None}
    assert tuple(got[5])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    kept = spark.read.parquet(f"{tmp_path}/conversations.parquet").where("conv_id = 6 OR conv_id IS NULL")
    assert repair.damaged(kept).where(F.col("role").isNull() | F.col("text").isNull()).count() == 0


def repair_kind(conv, turn):
    import zlib

    return zlib.crc32(f"{conv}:{turn}".encode()) % 20
