"""Readers of profile text files as DataFrames. A malformed row has a ``parse_error`` instead of ending the job.

Files are read whole, one row each, split into numbered lines, and each line takes the section of the last marker before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.scalar import base_name, without_extension
from loomspan.operators.profile import ALPHABETIC

# Letters of the eight secondary-structure states; header prefixes; section markers; header lines to skip.
STATES = "HGIEBTSL"
HEADERS = {
    "SEQRES sequence": "sequence", "DSSP   sequence": "dssp", "Sequence": "sequence", "SSEseq": "sse", "SSEconf": "sse_conf",
    "ACCseq": "acc", "ACCconf": "acc_conf", "NEFF": "neff", "EVD": "evd", "Template Name": "name",
}
MARKER = "////////////"
SECTIONS = {"Features": 1, "Original SS2": 1, "Original HHM": 5, "Original SS3+SS8+ACC": 2, "Original DIS": 1}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """profile_id, line_no, line, section, at (line in its section, from 1 after its header lines).

    A profile's id is its file's name or, where folders name one (profile_id=...), the folder's."""
    files = spark.read.text(path, wholetext=True)
    own = F.col("profile_id").cast("string") if "profile_id" in files.columns else without_extension(base_name(F.col("_metadata.file_path")))
    text = files.select(own.alias("profile_id"), F.split("value", "\r?\n").alias("ls"))
    rows = text.select("profile_id", F.posexplode("ls").alias("line_no", "line"))
    w = Window.partitionBy("profile_id").orderBy("line_no")
    mark = F.when(F.col("line").startswith(MARKER), F.struct(F.trim(F.regexp_replace("line", f"^{MARKER}|(?i)\\s*file\\s*$", "")).alias("name"), F.col("line_no").alias("from")))
    rows = rows.withColumn("s", F.last(mark, ignorenulls=True).over(w))
    skip = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("s.name")), F.lit(0))
    return rows.select("profile_id", "line_no", "line", F.coalesce("s.name", F.lit("")).alias("section"), (F.col("line_no") - F.col("s.from") - skip).alias("at"))


def headers(rows: DataFrame) -> DataFrame:
    """One row for each profile: name, sequence and the other header fields as text; EVD defaults to (0, 1)."""
    head = rows.where("section = ''")
    fields = [F.max(F.when(F.col("line").rlike(f"^{k}\\s*="), F.trim(F.regexp_replace("line", "^[^=]*=", "")))).alias(f"{v}_{i}") for i, (k, v) in enumerate(HEADERS.items())]
    found = head.groupBy("profile_id").agg(*fields)
    names: dict[str, list[str]] = {}
    for i, v in enumerate(HEADERS.values()):
        names.setdefault(v, []).append(f"{v}_{i}")
    out = found.select("profile_id", *[F.coalesce(*c).alias(v) for v, c in names.items()])
    evd = F.split(F.col("evd"), r"\s+")
    return out.withColumn("length", F.length("sequence")).withColumn("neff", F.col("neff").try_cast("double")).withColumn(
        "evd", F.struct(F.coalesce(F.get(evd, F.lit(0)).try_cast("double"), F.lit(0.0)).alias("lambda"), F.coalesce(F.get(evd, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("mu"))
    ).withColumn("parse_error", F.when(F.col("sequence").isNull(), "no sequence"))


def _tokens(line: str = "line") -> Column:
    return F.split(F.trim(line), r"\s+")


def template_features(rows: DataFrame) -> DataFrame:
    """profile_id, pos, aa, is_missing, ss8, core, acc_class, pacc, contacts, ca, cb, parse_error."""
    t = rows.where("section = 'Features' AND at >= 1 AND trim(line) <> ''").select("profile_id", F.col("at").alias("pos"), _tokens().alias("t"))

    def number(i: int, kind: str) -> Column:
        return F.get("t", F.lit(i)).try_cast(kind)

    missing = number(2, "int")
    xyz = [F.when(missing == 0, F.array(*[number(i, "double") for i in r])) for r in (range(9, 12), range(12, 15))]
    bad = (
        F.when(missing.isNull() | ~missing.isin(0, 1), "missing flag").when(F.instr(F.lit(STATES), F.get("t", F.lit(3))) == 0, "structure letter")
        .when(number(5, "int").isNull() | ~number(5, "int").between(0, 2), "accessibility").when(~F.coalesce(number(7, "int").between(0, 20) & number(8, "int").between(0, 20), F.lit(False)), "contacts")
        .when((missing == 0) & F.exists(F.concat(*xyz), lambda v: v.isNull()), "coordinates")
    )
    return t.select(
        "profile_id", "pos", F.get("t", F.lit(1)).alias("aa"), (missing == 1).alias("is_missing"), F.get("t", F.lit(3)).alias("ss8"), F.get("t", F.lit(4)).alias("core"), number(5, "int").alias("acc_class"), number(6, "double").alias("pacc"),
        number(7, "int").alias("ca_contact"), number(8, "int").alias("cb_contact"), xyz[0].alias("ca"), xyz[1].alias("cb"), bad.alias("parse_error"),
    )


def target_features(rows: DataFrame) -> DataFrame:
    """profile_id, pos, ss3, ss8, acc, parse_error: predicted class probabilities."""
    t = rows.where("section = 'Original SS3+SS8+ACC' AND at >= 1 AND trim(line) <> ''").select("profile_id", F.col("at").alias("pos"), F.transform(_tokens(), lambda x: x.try_cast("double")).alias("v"))
    return t.select("profile_id", "pos", F.slice("v", 1, 3).alias("ss3"), F.slice("v", 4, 8).alias("ss8"), F.slice("v", 12, 3).alias("acc"), F.when((F.size("v") != 14) | F.exists("v", lambda x: x.isNull()), "14 numbers").alias("parse_error"))


def disorder(rows: DataFrame) -> DataFrame:
    t = rows.where("section = 'Original DIS' AND at >= 1 AND trim(line) <> ''")
    return t.select("profile_id", F.col("at").alias("pos"), F.get(_tokens(), F.lit(4)).try_cast("double").alias("disorder"))


def profile_columns(rows: DataFrame, section: str = "Original HHM") -> DataFrame:
    """profile_id, pos, aa, emissions (milli-bits, alphabetic order, null for ``*``), transitions, neffs, parse_error.

    Three lines make a position; the third is blank."""
    body = rows.where((F.col("section") == section) & (F.col("at") >= 1) & ~F.col("line").startswith("//"))
    pos, kind = F.floor((F.col("at") - 1) / 3).cast("int") + 1, (F.col("at") - 1) % 3
    line = [F.max(F.when(kind == k, _tokens())).alias(f"t{k}") for k in (0, 1)]
    both = body.groupBy("profile_id", pos.alias("pos")).agg(*line).where("size(t0) > 1")

    def numbers(c: str, at: int, n: int) -> Column:
        return F.transform(F.slice(c, at, n), lambda x: F.when(x != "*", x.try_cast("double")))

    bad = F.when(F.size("t0") < len(ALPHABETIC) + 2, "20 emissions").when(F.size("t1") < 10, "10 transitions")
    return both.select("profile_id", "pos", F.get("t0", F.lit(0)).alias("aa"), numbers("t0", 3, 20).alias("emissions"), numbers("t1", 1, 7).alias("transitions"), F.transform(numbers("t1", 8, 3), lambda x: x / 1000).alias("neffs"), bad.alias("parse_error"))


def model_records(spark: SparkSession, path: str) -> DataFrame:
    """Standalone models, one for each record that ends with ``//``: name, sequence, length, null (milli-bits of 20 residues,
    alphabetic), lines (those behind the HMM line that aren't blank), parse_error."""
    text = spark.read.option("lineSep", "//\n").text(path).where("trim(value) <> ''")

    def field(k: str) -> Column:
        return F.trim(F.regexp_extract("value", rf"(?m)^{k}[ \t]+(.*)$", 1))

    body = F.split(F.regexp_extract("value", r"(?s)(?:^|\n)HMM[^\n]*\n(.*)$", 1), "\n")
    rows = text.select(field("NAME").alias("name"), field("SEQ").alias("sequence"), field("LENG").try_cast("int").alias("length"), _milli(F.split(field("NULL"), r"\s+")).alias("null"), F.filter(body, lambda x: F.trim(x) != "").alias("lines"))
    bad = F.when(F.size("lines") < 2, "no HMM block").when(F.col("length").isNull(), "no length").when(F.size("null") != 20, "20 background values")
    bad = bad.when((F.length("sequence") > 0) & (F.length("sequence") != F.col("length")), "sequence of another length").when(F.size("lines") != 2 + 2 * F.col("length"), "columns than the stated length are more or fewer")
    return rows.withColumn("parse_error", bad)


def _milli(tokens: Column) -> Column:
    """Milli-bits, null for ``*``."""
    return F.transform(tokens, lambda x: F.when(x != "*", x.try_cast("double")))


def model_columns(records: DataFrame) -> DataFrame:
    """name, pos, length, emissions, transitions and neffs of ``model_records``, for positions 0 to length + 1; parse_error.

    Position 0 has the transitions of the start, and the one behind the last has none; both have the background as emissions.
    The effective number of matches is 1 where the file has 0. Records with an error give one row with it."""
    good, n = F.col("parse_error").isNull(), F.col("length")
    split = lambda k: F.split(F.trim(F.get("lines", k)), r"\s+")
    none = F.array().cast("array<string>")
    column = lambda i: F.struct(i.cast("int").alias("pos"), F.when((i > 0) & (i <= n), split(2 * i)).otherwise(none).alias("e"), F.when(i == 0, split(F.lit(1))).when(i <= n, split(2 * i + 1)).otherwise(none).alias("t"))
    rows = records.select("name", "length", "null", "parse_error", F.explode(F.when(good, F.transform(F.sequence(F.lit(0), n + 1), column)).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("pos"), none.alias("e"), none.alias("t"))))).alias("c"))
    inner = F.col("c.pos").between(1, n)
    moves, counts = _milli(F.slice("c.t", 1, 7)), F.transform(_milli(F.slice("c.t", 8, 3)), lambda x: x / 1000)
    match = F.get(counts, F.lit(0))
    counts = F.when(F.col("c.pos") <= n, F.array(F.when(inner & (match == 0), 1.0).otherwise(match), F.get(counts, F.lit(1)), F.get(counts, F.lit(2)))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    bad = F.when(inner & (F.size("c.e") < 22), "20 emissions").when((F.col("c.pos") <= n) & (F.size("c.t") < 10), "10 transitions")
    emissions = F.when(inner, _milli(F.slice("c.e", 3, 20))).otherwise(F.col("null"))
    return rows.select("name", "c.pos", "length", emissions.alias("emissions"), F.when(F.col("c.pos") <= n, moves).alias("transitions"), counts.alias("neffs"), F.coalesce("parse_error", bad).alias("parse_error"))


def pair_distances(spark: SparkSession, path: str, floor: float = 0.01) -> DataFrame:
    """i, j, probs in both directions; zero probabilities become ``floor``."""
    t = spark.read.text(path).where("trim(value) <> ''").select(_tokens("value").alias("t"))
    rows = t.select(F.get("t", F.lit(0)).try_cast("int").alias("i"), F.get("t", F.lit(1)).try_cast("int").alias("j"), F.transform(F.slice("t", 3, 13), lambda x: F.when(x.try_cast("double") == 0, floor).otherwise(x.try_cast("double"))).alias("probs"))
    return rows.unionByName(rows.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "probs"))


def fasta_alignments(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, names and gapped strings of files with two records, on one line or several.

    A record of several lines has a header line, of which the first word is the name and the rest a description; in a record
    of one line the sequence follows the name."""
    records = F.filter(F.split("value", r"(?:^|(?<=\s))>"), lambda r: F.trim(F.regexp_replace(r, r"\s+", " ")) != "")
    text = spark.read.text(path, wholetext=True).select(without_extension(base_name(F.col("_metadata.file_path"))).alias("pair_id"), records.alias("r"))

    def record(k: int) -> tuple[Column, Column]:
        r = F.regexp_replace(F.get("r", F.lit(k)), r"^\s+|\s+$", "")
        head = F.when(r.contains("\n"), r"^[^\n]*").otherwise(r"^\S+")
        return F.regexp_extract(r, r"^\S+", 0), F.regexp_replace(F.regexp_replace(r, head, F.lit("")), r"\s+", "")

    (name_a, a), (name_b, b) = record(0), record(1)
    rows = text.select("pair_id", name_a.alias("name_a"), name_b.alias("name_b"), a.alias("a"), b.alias("b"), F.size("r").alias("n"))
    bad = F.when(F.col("n") < 2, "two records").when(F.length("a") != F.length("b"), "unequal lengths")
    return rows.select("pair_id", "name_a", "name_b", "a", "b", bad.alias("parse_error"))


def fasta_sequences(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """profile_id, sequence: the lines after ``skip`` header lines put together."""
    text = spark.read.text(path, wholetext=True)
    ls = F.split("value", "\r?\n")
    return text.select(without_extension(base_name(F.col("_metadata.file_path"))).alias("profile_id"), F.regexp_replace(F.array_join(F.slice(ls, skip + 1, F.greatest(F.size(ls) - skip, F.lit(1))), ""), r"\s+", "").alias("sequence"))
