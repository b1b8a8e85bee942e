"""Writers of alignments and posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_fasta(gapped: DataFrame, path: str, a: str = "a", b: str = "b") -> None:
    """Two records for each pair; ``gapped`` has name_a, name_b and the gapped strings."""
    gapped.select(F.concat(F.lit(">"), "name_a", F.lit("\n"), a, F.lit("\n>"), "name_b", F.lit("\n"), b).alias("value")).write.text(path)


def write_posterior(cells: DataFrame, path: str, least: float = 0.0) -> None:
    """pair_id, state, x, y, p as Parquet, by state."""
    cells.where(F.col("p") > least).write.partitionBy("state").parquet(path)


def _numbers(values: Column, digits: int = 6) -> Column:
    return F.array_join(F.transform(values, lambda x: F.format_string(f"%.{digits}f", x)), " ")


def _profile_lines(c: Column) -> Column:
    """The three lines of a position in a profile section: emissions, transitions and effective numbers, in milli-bits and
    thousandths."""
    put = lambda a: F.array_join(F.transform(a, lambda x: F.coalesce(F.round(x).cast("long").cast("string"), F.lit("*"))), " ")
    return F.concat(c["aa"], F.lit(" "), c["pos"].cast("string"), F.lit(" "), put(c["emissions"]), F.lit(" "), c["pos"].cast("string"), F.lit("\n"), put(F.concat(c["transitions"], c["neffs"])), F.lit("\n\n"))


def _gathered(positions: DataFrame, columns: list[str]) -> DataFrame:
    return positions.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("z"))


def _section(name: str, heads: int, line) -> Column:
    return F.concat(F.lit(f"//////////// {name} file\n" + "head\n" * heads), F.array_join(F.transform("z", line), ""))


PROFILE = ["aa", "emissions", "transitions", "neffs"]


def template_text(positions: DataFrame) -> DataFrame:
    """profile_id, value: template files. ``positions`` have profile_id, pos, aa, is_missing, ss8_letter, acc_class,
    ca_contact, cb_contact, ca, cb (three coordinates, null where missing) and the columns PROFILE."""
    rows = _gathered(positions, ["is_missing", "ss8_letter", "acc_class", "ca_contact", "cb_contact", "ca", "cb", *PROFILE])

    def feature(c: Column) -> Column:
        text = [c["pos"].cast("string"), c["aa"], c["is_missing"].cast("int").cast("string"), c["ss8_letter"], F.lit("A"), c["acc_class"].cast("string"), F.lit("10"), c["ca_contact"].cast("string"), c["cb_contact"].cast("string")]
        return F.concat(F.concat_ws(" ", *text, F.when(~c["is_missing"], _numbers(F.concat(c["ca"], c["cb"])))), F.lit("\n"))

    head = F.concat(F.lit("Template Name  = "), F.col("profile_id").cast("string"), F.lit("\nSEQRES sequence = "), F.array_join("z.aa", ""), F.lit("\n"))
    return rows.select("profile_id", F.concat(head, _section("Features", 1, feature), _section("Original HHM", 5, _profile_lines)).alias("value"))


def target_text(positions: DataFrame) -> DataFrame:
    """profile_id, value: target files. ``positions`` have profile_id, pos, aa, ss3, ss8, acc, disorder and PROFILE."""
    rows = _gathered(positions, ["ss3", "ss8", "acc", "disorder", *PROFILE])
    classes = lambda c: F.concat(_numbers(F.concat(c["ss3"], c["ss8"], c["acc"])), F.lit("\n"))
    disorder = lambda c: F.concat(F.concat_ws(" ", c["pos"].cast("string"), c["aa"], F.lit(". ."), F.format_string("%.6f", c["disorder"])), F.lit("\n"))
    head = F.concat(F.lit("Sequence = "), F.array_join("z.aa", ""), F.lit("\nEVD = 0.3 20\n"))
    return rows.select("profile_id", F.concat(head, _section("Original SS3+SS8+ACC", 2, classes), _section("Original HHM", 5, _profile_lines), _section("Original DIS", 1, disorder)).alias("value"))


def write_profiles(texts: DataFrame, path: str) -> None:
    """A folder for each profile, named by its id, with its text as one file."""
    texts.write.partitionBy("profile_id").text(path)


def model_text(df: DataFrame) -> DataFrame:
    """name, value: records as ``text_profiles.model_records`` reads them, without the line ``//`` at their end.

    ``df`` has name, sequence, null and ``columns``, an array of (pos, emissions, transitions, neffs) from position 0 on, in
    milli-bits and thousandths, null for none."""
    put = lambda a: F.array_join(F.transform(a, lambda x: F.coalesce(F.round(x).cast("long").cast("string"), F.lit("*"))), "\t")
    moves = lambda c: F.concat(F.lit("  "), put(F.concat(c["transitions"], c["neffs"])))
    rest = F.slice("columns", F.lit(2), F.size("columns"))
    body = F.transform(rest, lambda c: F.concat(F.substring(F.col("sequence"), c["pos"], F.lit(1)), F.lit(" "), c["pos"].cast("string"), F.lit("\t"), put(c["emissions"]), F.lit("\t"), c["pos"].cast("string"), F.lit("\n"), moves(c), F.lit("\n")))
    head = [F.lit("NAME  "), F.col("name"), F.lit("\nSEQ   "), F.col("sequence"), F.lit("\nLENG  "), (F.size("columns") - 1).cast("string"), F.lit("\nNULL  "), put(F.col("null"))]
    return df.select("name", F.concat(*head, F.lit("\nHMM    residues\n       transitions\n"), moves(F.get("columns", F.lit(0))), F.lit("\n"), F.array_join(body, "\n")).alias("value"))


def write_models(df: DataFrame, path: str) -> None:
    """Files of model records, as many as ``df`` has partitions."""
    model_text(df).select("value").write.option("lineSep", "//\n").text(path)
