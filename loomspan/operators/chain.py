"""The chained program of a template and a target: align, mend, score anew, compare with a known alignment, search.

Potentials are computed once, by tiles, and checkpointed in the order in which both passes over them read: ``best_paths``
sweeps a pair's tiles as they stream by, from one anti-diagonal of tiles to the next, so it holds two of these, and a byte
for each cell to trace back; ``searched`` holds the whole of one pair. Everything between is joins, windows and grouping.

Positions and pairs are those of ``potentials``; templates also have is_missing and ca.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import alignment, refine
from loomspan.operators.dynamic import NONE, PENALTIES, RADIUS, THREE
from loomspan.operators.potentials import MATCH, TARGET_GAPS, TEMPLATE_GAPS, gap_potentials
from loomspan.operators.profile import MATRIX_ORDER, UNKNOWN, same_state_as_before
from loomspan.operators.staging import checkpointed
from loomspan.operators.sweeps import Geometry, Sweep
from loomspan.operators.tiles import TILE, Scoring, cell_potentials, tile_potentials

SIDE = ["known", "follows", "ca_x", "ca_y", "ca_z", *TEMPLATE_GAPS], ["known", *TARGET_GAPS]
#: Pairs of one tile that are swept together.
TOGETHER = 32


def with_gaps(templates: DataFrame, targets: DataFrame, scoring: Scoring) -> tuple[DataFrame, DataFrame]:
    """Both sides with the potentials of their gaps and what else a sweep asks for."""
    known = F.col("aa_idx") < UNKNOWN
    rows = templates.withColumns({"known": known & ~F.col("is_missing"), "follows": same_state_as_before("ss", "profile_id", "pos")})
    rows = rows.withColumns({f"ca_{c}": F.get("ca", F.lit(k)) for k, c in enumerate("xyz")})
    sides = zip((rows, targets.withColumn("known", known)), ("template", "target"), strict=True)
    first, second = (side.join(gap_potentials(side, scoring.model, name), ["profile_id", "pos"]) for side, name in sides)
    return first, second


def laid_tiles(pairs: DataFrame, templates: DataFrame, targets: DataFrame, scoring: Scoring, size: int = TILE) -> DataFrame:
    """The tiles of ``with_gaps`` sides: all of a pair in one task, by anti-diagonal; pairs of like length side by side."""
    tiles = tile_potentials(pairs, templates, targets, scoring, size, SIDE)
    tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(tiles.repartition(tasks, "pair_id").sortWithinPartitions("lx", "ly", "pair_id", F.col("tx") + F.col("ty"), "tx"))


@dataclass
class Tile:
    pair_id: object
    kind: pa.DataType
    lx: int
    ly: int
    at: int  # anti-diagonal of tiles
    x0: int
    y0: int
    match: np.ndarray  # [3, x, y]
    x: np.ndarray  # [x, SIDE[0]]
    y: np.ndarray  # [y, SIDE[1]]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    for batch in batches:
        ints = {c: batch.column(c).to_pylist() for c in ("pair_id", "lx", "ly", "tx", "ty", "x0", "y0", "nx", "ny")}
        for k in range(batch.num_rows):
            i = {c: v[k] for c, v in ints.items()}
            match = np.stack([batch.column(c)[k].values.to_numpy().reshape(i["nx"], i["ny"]) for c in MATCH])
            x, y = (np.frombuffer(batch.column(c)[k].as_py()).reshape(-1, len(names)) for c, names in zip(("sx", "sy"), SIDE, strict=True))
            yield Tile(i["pair_id"], batch.schema.field("pair_id").type, i["lx"], i["ly"], i["tx"] + i["ty"], i["x0"], i["y0"], match, x, y)


class Band:
    """Weights of THREE under penalties, and the chain, for pairs whose tiles come in by anti-diagonals."""

    def __init__(self, tiles: list[Iterator[Tile]], lengths: np.ndarray, size: int, mode: str):
        self.tiles, self.lengths, self.size, self.p = tiles, lengths, size, PENALTIES[mode]
        pairs, lx, ly = len(lengths), *lengths.max(0)
        self.next, self.held = [next(t, None) for t in tiles], [[] for _ in tiles]
        self.known = np.zeros((pairs, lx + 1), bool), np.zeros((pairs, ly + 1), bool)
        self.gap_x, self.gap_y = np.full((len(TEMPLATE_GAPS), pairs, lx + 1), NONE), np.full((len(TARGET_GAPS), pairs, ly + 1), NONE)
        self.geometry = Geometry(np.zeros((pairs, lx), bool), np.full((pairs, lx, 3), np.nan), RADIUS)

    def _load(self, last: int) -> None:
        for b, tiles in enumerate(self.tiles):
            while (t := self.next[b]) is not None and t.at <= last:
                xs, ys = slice(t.x0, t.x0 + len(t.x)), slice(t.y0, t.y0 + len(t.y))
                self.known[0][b, xs], self.known[1][b, ys] = t.x[:, 0] > 0, t.y[:, 0] > 0
                self.geometry.follows[b, t.x0 - 1 : t.x0 - 1 + len(t.x)] = t.x[:, 1] > 0
                self.geometry.at[b, t.x0 - 1 : t.x0 - 1 + len(t.x)] = t.x[:, 2:5]
                self.gap_x[:, b, xs], self.gap_y[:, b, ys] = t.x[:, 5:].T, t.y[:, 1:].T
                self.held[b].append(t)
                self.next[b] = next(tiles, None)
            self.held[b] = [t for t in self.held[b] if t.at >= last - 2]

    def __call__(self, d: int, x0: int, x1: int) -> np.ndarray:
        self._load((d - 1) // self.size)
        x = np.arange(x0, x1 + 1)
        y, p = d - x, self.p
        match = np.zeros((3, len(self.tiles), len(x)))
        for b, held in enumerate(self.held):
            for t in held:
                _, nx, ny = t.match.shape
                lo, hi = max(x0, t.x0, d - t.y0 - ny + 1), min(x1, t.x0 + nx - 1, d - t.y0)
                if lo <= hi:
                    step, first = max(1, ny - 1), (lo - t.x0) * ny + d - lo - t.y0
                    match[:, b, lo - x0 : hi - x0 + 1] = t.match.reshape(3, -1)[:, first : first + (hi - lo) * step + 1 : step]
        lx, ly = self.lengths[:, :1], self.lengths[:, 1:]
        inside = (x >= 1) & (y >= 1) & (x <= lx) & (y <= ly)
        edge = (x == 1) | (x == lx) | (y == 1) | (y == ly)
        base = np.where(self.known[0][:, x] & self.known[1][:, y], p["mm"], p["xx"]) - np.where(edge, p["mm"], 0.0)
        out = np.empty((len(THREE.arcs), len(self.tiles), len(x)))
        out[[0, 3, 6]] = np.where(inside, np.clip(match, *p["clip"]) + base, NONE)
        out[1], out[4] = self.gap_x[0][:, x] + p["mi"], self.gap_x[1][:, x] + p["ii"]
        out[2], out[7], out[5] = (self.gap_y[k][:, y] + p[c] for k, c in enumerate(TARGET_GAPS))
        return out


def _swept(size: int, mode: str):
    def swept(tiles: list[Iterator[Tile]], ids: pa.Array, lengths: list[tuple[int, int]]) -> pa.RecordBatch:
        band = Band(tiles, np.array(lengths), size, mode)
        # Of equal ends a gap's comes before a match's.
        value, paths = Sweep(THREE, band.lengths, band).best("local", band.geometry, order=(2, 1, 0), once=True)
        columns = list(zip(*lengths, strict=True))
        steps = [[{"state": s, "x": x, "y": y} for s, x, y in path] for path in paths]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(value), pa.array(steps, pa.list_(pa.struct([(c, pa.int32()) for c in ("state", "x", "y")])))],
            names=["pair_id", "lx", "ly", "raw", "path"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[Tile] = []

        def together() -> pa.RecordBatch:
            out = swept([iter([t]) for t in small], pa.array([t.pair_id for t in small], small[0].kind), [(t.lx, t.ly) for t in small])
            small.clear()
            return out

        for pair_id, tiles in groupby(_read(batches), lambda t: t.pair_id):
            first = next(tiles)
            if max(first.lx, first.ly) <= size:
                small.append(first)
                if len(small) == TOGETHER:
                    yield together()
                continue
            yield swept([(t for part in ([first], tiles) for t in part)], pa.array([pair_id], first.kind), [(first.lx, first.ly)])
        if small:
            yield together()

    return run


def best_paths(tiles: DataFrame, size: int = TILE, mode: str = "template") -> DataFrame:
    """pair_id, lx, ly, raw, path: the best local path of each pair of ``laid_tiles`` under the penalties and the chain."""
    kind = dict(tiles.dtypes)["pair_id"]
    return tiles.mapInArrow(_swept(size, mode), f"pair_id {kind}, lx int, ly int, raw double, path array<struct<state:int,x:int,y:int>>")


def matches_of(paths: DataFrame) -> DataFrame:
    return paths.select("pair_id", F.explode("path").alias("s")).where("s.state = 0").select("pair_id", "s.x", "s.y")


def of_profile(pairs: DataFrame, positions: DataFrame, key: str, place: str) -> DataFrame:
    """pair_id, the position as ``place``, aa and known, of the profile ``key`` of each pair."""
    letter = F.when(F.col("aa_idx") < UNKNOWN, F.substring(F.lit(MATRIX_ORDER), F.col("aa_idx") + 1, F.lit(1))).otherwise("X")
    rows = positions.select(F.col("profile_id").alias(key), F.col("pos").alias(place), letter.alias("aa"), "known")
    return pairs.select("pair_id", key).join(rows, key).drop(key)


def mended(paths: DataFrame, pairs: DataFrame, templates: DataFrame, targets: DataFrame) -> DataFrame:
    """pair_id, step, x, y: whole alignments. Blocks go on over equal residues, then matches of unknown or missing residues
    go; gaps of the template come first."""
    sides = {c: of_profile(pairs, rows, key, c) for rows, key, c in ((templates, "template_id", "x"), (targets, "target_id", "y"))}
    found = alignment.extended(matches_of(paths), sides["x"].drop("known"), sides["y"].drop("known"), "pair_id")
    for c, rows in sides.items():
        found = found.join(rows.where("known").select("pair_id", c), ["pair_id", c], "left_semi")
    return alignment.canonical(paths.select("pair_id", "lx", "ly"), found, "pair_id")


def scored(steps: DataFrame, pairs: DataFrame, templates: DataFrame, targets: DataFrame, scoring: Scoring, size: int = TILE, mode: str = "template") -> DataFrame:
    """pair_id, score, lali: of whole alignments of ``with_gaps`` sides, by the potentials of their steps alone."""
    inside = alignment.spans(steps, "pair_id").join(pairs.select("pair_id", "template_id", "target_id"), "pair_id")
    on = inside.where("state = 0")
    cells = cell_potentials(pairs, templates, targets, scoring, size, on.select("pair_id", "x", "y"))

    def by_state(names: list[str]):
        out = F.when(F.lit(False), 0.0)
        for k, c in enumerate(names):
            out = out.when(F.col("before") == k, F.col(c))
        return out.otherwise(0.0)

    rows = on.join(cells, ["pair_id", "x", "y"]).withColumn("phi", by_state(list(MATCH)))
    for state, side, key, place, names in ((1, templates, "template_id", "x", ["mi", "ii"]), (2, targets, "target_id", "y", ["md", "id", "dd"])):
        gaps = side.select(F.col("profile_id").alias(key), F.col("pos").alias(place), *names)
        rows = rows.unionByName(inside.where(F.col("state") == state).join(gaps, [key, place]).withColumn("phi", by_state(names)), allowMissingColumns=True)
    return alignment.rescored(rows, "pair_id", PENALTIES[mode])


def aligned(pairs: DataFrame, templates: DataFrame, targets: DataFrame, scoring: Scoring, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """pair_id, raw, score, lali, lx, ly of each pair, and the steps of its mended alignment."""
    first, second = map(checkpointed, with_gaps(templates, targets, scoring))
    paths = checkpointed(best_paths(laid_tiles(pairs, first, second, scoring, size), size))
    steps = checkpointed(mended(paths, pairs, first, second))
    scores = scored(steps, pairs, first, second, scoring, size)
    scores = paths.select("pair_id", "raw", "lx", "ly").join(scores, "pair_id", "left")
    return scores.select("pair_id", "raw", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("lali", F.lit(0).cast("long")).alias("lali"), "lx", "ly"), steps


def _table(match: np.ndarray, gap_x: np.ndarray, gap_y: np.ndarray) -> refine.Table:
    """Potentials of THREE in windows, without penalties."""

    def window(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        phi = THREE.potentials(x1 - x0, y1 - y0)
        phi[[0, 3, 6], 1:, 1:] = match[:, x0:x1, y0:y1]
        for names, values, side in ((TEMPLATE_GAPS, gap_x, x0), (TARGET_GAPS, gap_y, y0)):
            for k, m in enumerate(names.values()):
                if names is TEMPLATE_GAPS:
                    phi[m, 1:] = values[k, side:x1, None]
                else:
                    phi[m, :, 1:] = values[k, side:y1]
        return phi

    return window


def searched(tiles: DataFrame, steps: DataFrame, known: DataFrame, reach: int = refine.RANGE, depth: int = refine.DEPTH) -> DataFrame:
    """pair_id, x, y: matches after the greedy search from ``steps`` towards the ``known`` alignment (pair_id, x, y, null for
    a gap). Pairs without a known alignment keep theirs. A pair's cells are one group, at some 24 bytes each."""
    cell = F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    own, truth = (alignment.matches(rows).groupBy("pair_id").agg(F.collect_list(cell).alias(name)) for rows, name in ((steps, "own"), (known, "truth")))
    sides = steps.select("pair_id").distinct().join(own, "pair_id", "left").join(truth, "pair_id", "left")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        tiles = list(_read(left.to_batches()))
        rows = right.to_pylist()
        cells: refine.Pairs = set()
        if tiles and rows:
            lx, ly = tiles[0].lx, tiles[0].ly
            match, gap_x, gap_y = np.zeros((3, lx, ly)), np.zeros((len(TEMPLATE_GAPS), lx)), np.zeros((len(TARGET_GAPS), ly))
            for t in tiles:
                xs, ys = slice(t.x0 - 1, t.x0 - 1 + len(t.x)), slice(t.y0 - 1, t.y0 - 1 + len(t.y))
                match[:, xs, ys], gap_x[:, xs], gap_y[:, ys] = t.match, t.x[:, 5:].T, t.y[:, 1:].T
            own, truth = ({(c["x"], c["y"]) for c in rows[0][name] or []} for name in ("own", "truth"))
            cells = own
            if truth:
                cells = refine.search(_table(match, gap_x, gap_y), refine.Partners.of(own, lx, ly), refine.known_mates(truth, ly), reach, depth).pairs()
        found = sorted(cells)
        ids = pa.array([rows[0]["pair_id"]] * len(found) if rows else [], right.schema.field("pair_id").type)
        return pa.Table.from_arrays([ids, *[pa.array([c[k] for c in found], pa.int32()) for k in (0, 1)]], names=["pair_id", "x", "y"])

    kind = dict(tiles.dtypes)["pair_id"]
    return tiles.groupBy("pair_id").cogroup(sides.groupBy("pair_id")).applyInArrow(one, f"pair_id {kind}, x int, y int")


@dataclass
class Chain:
    """``scores`` (pair_id, raw, score, lali, lx, ly), ``before`` and ``after`` (pair_id, step, x, y: the mended and the
    searched alignment) and ``overlap`` (pair_id, known, aligned, before, after: numbers of matches, and of those shared)."""

    scores: DataFrame
    before: DataFrame
    after: DataFrame
    overlap: DataFrame


def run(pairs: DataFrame, templates: DataFrame, targets: DataFrame, scoring: Scoring, known: DataFrame, reach: int = refine.RANGE, depth: int = refine.DEPTH, size: int = TILE) -> Chain:
    """The whole program, with ``known`` alignments (pair_id, x, y, null for a gap) to search towards."""
    first, second = map(checkpointed, with_gaps(templates, targets, scoring))
    tiles = laid_tiles(pairs, first, second, scoring, size)
    paths = checkpointed(best_paths(tiles, size))
    before = checkpointed(mended(paths, pairs, first, second))
    scores = paths.select("pair_id", "raw", "lx", "ly").join(scored(before, pairs, first, second, scoring, size), "pair_id", "left").na.fill({"score": 0.0, "lali": 0})
    after = checkpointed(alignment.canonical(paths.select("pair_id", "lx", "ly"), searched(tiles, before, known, reach, depth), "pair_id"))
    numbers = {"known": known, "aligned": before}
    overlap = paths.select("pair_id")
    for name, rows in numbers.items():
        overlap = overlap.join(alignment.matches(rows).groupBy("pair_id").agg(F.count("*").alias(name)), "pair_id", "left")
    for name, rows in (("before", before), ("after", after)):
        overlap = overlap.join(alignment.common(rows, known, "pair_id").withColumnRenamed("common", name), "pair_id", "left")
    return Chain(scores.select("pair_id", "raw", "score", "lali", "lx", "ly"), before, after, overlap.na.fill(0))


def sequences(pairs: DataFrame, templates: DataFrame, targets: DataFrame) -> DataFrame:
    """pair_id, name_a, name_b, a, b: both profiles' names and letters, X for unknown ones."""
    out = pairs.select("pair_id", F.col("template_id").cast("string").alias("name_a"), F.col("target_id").cast("string").alias("name_b"))
    for rows, key, name in ((templates, "template_id", "a"), (targets, "target_id", "b")):
        letters = of_profile(pairs, rows.withColumn("known", F.lit(True)), key, "pos").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "aa"))).alias("z"))
        out = out.join(letters.select("pair_id", F.array_join("z.aa", "").alias(name)), "pair_id")
    return out


def fasta(steps: DataFrame, texts: DataFrame) -> DataFrame:
    """pair_id, name_a, name_b and the gapped strings a, b of whole alignments, as ``writers.write_fasta`` takes them."""
    gapped = alignment.gapped(steps.join(texts, "pair_id"), "pair_id", "a", "b")
    return texts.select("pair_id", "name_a", "name_b").join(gapped, "pair_id")
