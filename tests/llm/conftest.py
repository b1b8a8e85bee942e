import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, m string, kept boolean, bands string"


def rows():
    """Nulls, empty and long texts, repeated rows and copies, and columns whose names the operators use inside."""
    line = "The quick brown fox jumps over the lazy dog and runs away from it."
    para = "\n".join(f"{line} Number {k} follows in this text." for k in range(12))
    long = " ".join(f"word{k % 977} and{k}" for k in range(30_000))
    out = [
        (1, para, "en"), (2, para, "en"), (2, para, "en"), (3, para.replace("lazy", "sleepy", 1), "en"), (4, None, "en"), (5, "", None), (6, " \t\n\r ", "en"),
        (7, long, "en"), (None, "An id is missing here, but the text is not.", "en"), (8, "a" * 5000, "en"), (9, "ab " * 900, "de"), (10, "1234 !!!", "de"),
        (11, "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon.", "de"), (12, "x\ny\nz\nx\ny\nz\nx\ny\nz", None), (13, "one two three", "en"), (14, "one  two\tthree", "en"),
        (15, "Mail a.b@c.org or +1 (988) 555-2485, later (988) 555-2485; 10.0.0.1 and 4111 1111 1111 1111.", "en"), (16, "\U0001f600" * 300, "xx"), (17, "<|endoftext|> end", "en"),
    ]
    return [(i, t, g, "s", None if t is None else len(t), 0, "m", None, "b") for i, t, g in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in rows()]
