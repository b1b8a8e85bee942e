"""Readers on synthetic files, writers, algebra corner cases and streaming."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import edit, scalar, vectors
from loomspan.operators import alignment, profile
from loomspan.sources import text_profiles, writers
from loomspan.streaming import scoring

TPL = """Template Name  = 1abc
SEQRES sequence = ACDX
DSSP   sequence = ACD-
NEFF  = 4.5
//////////// Features
Num Res  Missing   SSE    CLE   ACC   pACC  CNa CNb   Xca       Yca       Zca       Xcb       Ycb       Zcb
1 A 0 H A 0 10 3 4 1.0 2.0 3.0 1.5 2.5 3.5
2 C 0 E B 2 20 3 4 4.8 2.0 3.0 1.5 2.5 3.5
3 D 1 L C 1 30 0 0
4 X 0 Q C 1 30 0 0 1 2 3 4 5 6
//////////// Original HHM file
h1
h2
h3
h4
h5
A 1 1000 * * * * * * * * * * * * * * * * * * 1000
100 2000 * 500 * 0 * 3000 0 1000

C 2 * 0 * * * * * * * * * * * * * * * * * *
100 2000 * 500 * 0 * 3000 0 1000

//
"""


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tpl")
    (d / "1abc.tpl").write_text(TPL)
    return text_profiles.lines(spark, str(d))


def test_headers(rows):
    h = text_profiles.headers(rows).collect()[0]
    assert (h.profile_id, h.name, h.sequence, h.length, h.neff, h.evd["lambda"], h.evd.mu, h.parse_error) == ("1abc", "1abc", "ACDX", 4, 4.5, 0.0, 1.0, None)


def test_features(rows):
    f = text_profiles.template_features(rows).orderBy("pos").collect()
    assert [(r.pos, r.aa, r.is_missing, r.ss8, r.parse_error) for r in f] == [(1, "A", False, "H", None), (2, "C", False, "E", None), (3, "D", True, "L", None), (4, "X", False, "Q", "structure letter")]
    assert f[0].ca == [1.0, 2.0, 3.0] and f[2].ca is None


def test_columns(rows):
    c = text_profiles.profile_columns(rows).orderBy("pos").collect()
    assert [(r.pos, r.aa, r.parse_error) for r in c] == [(1, "A", None), (2, "C", None)]
    assert c[0].emissions[0] == 1000 and c[0].emissions[1] is None and c[0].transitions[:4] == [100, 2000, None, 500] and c[0].neffs == [3.0, 0.0, 1.0]


def test_fasta(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.fasta").write_text(">a AC-D\n>b A-CD\n")
    (tmp_path / "in" / "p2.fasta").write_text(">a\nAC\nGT\n>b\nACG\n")
    got = text_profiles.fasta_alignments(spark, str(tmp_path / "in")).orderBy("pair_id")
    one, two = got.collect()
    assert (one.name_a, one.a, one.b, one.parse_error) == ("a", "AC-D", "A-CD", None) and two.parse_error == "unequal lengths"
    ali = alignment.from_gapped(got.where("parse_error IS NULL"), "pair_id", "a", "b")
    assert [(r.x, r.y) for r in ali.orderBy("step").collect()] == [(1, 1), (2, None), (None, 2), (3, 3)]
    back = alignment.gapped(ali.withColumn("a", F.lit("ACD")).withColumn("b", F.lit("ACD")), "pair_id", "a", "b")
    assert back.collect()[0][1:] == ("AC-D", "A-CD")
    writers.write_fasta(back.withColumn("name_a", F.lit("a")).withColumn("name_b", F.lit("b")), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect() if r.value] == [">a\nAC-D\n>b\nA-CD\n"]
    (tmp_path / "s.fa").write_text(">x\nAC\nGT\n")
    assert text_profiles.fasta_sequences(spark, str(tmp_path / "s.fa")).collect()[0].sequence == "ACGT"


def test_fasta_descriptions(spark, tmp_path):
    """The rest of a header line is no part of the sequence."""
    (tmp_path / "p.fasta").write_text(">1abc chain A -> B\nACGT\nAC\n>2xyz\r\nAC--\r\nAC\r\n")
    row = text_profiles.fasta_alignments(spark, str(tmp_path)).collect()[0]
    assert (row.name_a, row.a, row.name_b, row.b, row.parse_error) == ("1abc", "ACGTAC", "2xyz", "AC--AC", None)
    (tmp_path / "p.fasta").write_text(">only one\nACGT\n")
    assert text_profiles.fasta_alignments(spark, str(tmp_path)).collect()[0].parse_error == "two records"


def test_his_runs_of_any_length(spark):
    row = spark.range(1).select(*[profile.neutral_ranges(F.lit("A" * 20 + "H" * n + "A" * 20)).alias(f"h{n}") for n in (4, 5, 6, 9)]).collect()[0]
    assert (row.h4, row.h5, row.h6, row.h9) == ([], [[13, 33]], [[13, 34]], [[13, 37]])


def test_distances(spark, tmp_path):
    (tmp_path / "d").write_text("1 2 " + " ".join(["0"] + ["0.5"] * 12) + "\n")
    got = text_profiles.pair_distances(spark, str(tmp_path / "d")).collect()
    assert {(r.i, r.j) for r in got} == {(1, 2), (2, 1)} and got[0].probs[:2] == [0.01, 0.5]


def test_golden_overlap(spark):
    """A hand-worked pair of alignments that share one match."""
    truth = [(2, 1), (None, 2), (None, 3), (3, 4), (None, 5), (4, 6), (5, 7)]
    other = [(2, None), (None, 1), (3, None), (None, 2), (None, 3), (None, 4), (4, 5), (None, 6), (5, 7)]
    a, b = (spark.createDataFrame([(1, k, *p) for k, p in enumerate(x)], "pair_id long, step int, x int, y int") for x in (truth, other))
    assert alignment.common(a, b, "pair_id").collect()[0].common == 1
    assert alignment.common(a, a, "pair_id").collect()[0].common == 4
    assert alignment.first_difference(a, a, "pair_id").collect()[0]["first"] == -1


def test_repair_extends_equal_residues(spark):
    x, y = "AACDEF", "TACDEG"
    rx, ry = (spark.createDataFrame([(1, k + 1, c) for k, c in enumerate(s)], f"pair_id long, {n} int, aa string") for s, n in ((x, "x"), (y, "y")))
    found = spark.createDataFrame([(1, 3, 3)], "pair_id long, x int, y int")
    got = {(r.x, r.y) for r in alignment.extended(found, rx, ry, "pair_id").collect()}
    assert got == {(2, 2), (3, 3), (4, 4), (5, 5)}


def test_scores(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("AC", "AC"), ("A", "B")], "a string, b string")
    got = df.select(edit.global_score(F.col("a"), F.col("b"), 0.0, -1.0, -1.0), edit.local_score(F.col("a"), F.col("b"), 2.0, -1.0, -1.0)).collect()
    assert [tuple(r) for r in got] == [(-3.0, 7.0), (0.0, 4.0), (-1.0, 0.0)]


def test_columns_by_hand(spark):
    one = spark.range(1)
    arr = lambda *v: F.array(*map(F.lit, v))
    got = one.select(
        vectors.argmax3(F.lit(1.0), F.lit(1.0), F.lit(0.0)), vectors.confident(arr(0.005, 0.96, 0.2)), vectors.confident(arr(0.005, 0.9)), vectors.one_hot(F.lit(2), 4),
        vectors.distance(arr(0.0, 0.0), arr(3.0, 4.0)), vectors.distance(F.lit(None).cast("array<double>"), arr(3.0)), profile.his_tags(F.lit("MHHHAAAAAAAAAAAAAA")), profile.his_tags(F.lit("MHHHAAAAAAAAAAAAAAHHHH")),
        profile.neutral_ranges(F.lit("AAEQKLISEEDLA")), vectors.normalised(arr(0.0, 0.0)), scalar.first_int(F.lit("ab -12 c")), scalar.first_float(F.lit("x *")), scalar.round_half_up(F.lit(-1.5)),
        profile.transition(F.lit(1000.0), F.lit(3.0), "mm"), vectors.times_matrix(arr(1.0, 2.0), [[1, 2], [3, 4]]),
    ).collect()[0]
    assert got[0] == 2 and got[1] == [0, 1, 0] and got[2] == [0, 0.9] and got[3] == [0, 0, 1, 0] and got[4] == 5 and got[5] == 8
    assert got[6] == [2] and got[7] == [2, 20] and got[8] == [[3, 12]] and got[9] == [0, 0] and got[10] == -12 and got[11] == 99999 and got[12] == -1
    assert abs(got[13] - (3 * 0.5 + 0.06) / 3.1) < 1e-4 and got[14] == [7, 10]


def test_gap_transitions(spark):
    t = {k: F.lit(-1.0) for k in ("mm", "mi", "md", "im", "ii", "dm", "dd")}
    n = {k: F.lit(2.0) for k in "mid"}
    got = profile.gap_transitions(n, t, F.lit(False), F.lit(False))
    row = spark.range(1).select(*[F.pow(F.lit(2.0), c / profile.GAP.get({"md": "f", "mi": "g", "dd": "h", "ii": "i"}.get(k, "b"), 1.0)).alias(k) for k, c in got.items()]).collect()[0]
    assert abs(row.mm + row.mi + row.md - 1) < 1e-9 and abs(row["im"] + row.ii - 1) < 1e-9
    ends = profile.gap_transitions(n, t, F.lit(True), F.lit(False))
    assert spark.range(1).select(ends["md"], ends["mm"]).collect()[0][1] == 0.0


def test_stream(spark, tmp_path):
    spark.createDataFrame([("kitten", "sitting")], "a string, b string").write.parquet(str(tmp_path / "in"))
    pairs = spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in"))
    score = lambda df: df.select("a", "b", edit.global_score(F.col("a"), F.col("b"), 0.0, -1.0, -1.0).alias("score"))
    scoring.score_stream(pairs, score, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0].score == -3.0
