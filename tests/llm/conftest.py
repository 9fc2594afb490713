import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, digest string, size string, copy int, key string, host string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and names that clash."""
    clash = ("r", "i", "d", "s", 7, "k", "h")
    long_text = "\n".join(f"the long text has line {i} of many and says {i * i} there" for i in range(6000))
    rows = [
        (1, "one line here\nand a second line\nand a third one\nand a fourth one", "en", "a", 60, *clash),
        (2, "one line here\nand a second line\nand a third one\nsomething else", "en", "a", 58, *clash),
        (3, None, "en", "a", None, *clash),
        (4, "", None, "b", 0, *clash),
        (5, " \n\t\n", "en", "b", 4, *clash),
        (None, "one line here\nand a second line\nand a third one\nand a fourth one", None, None, None, *[None] * 7),
        (6, long_text, "en", "b", len(long_text), *clash),
        (7, "x", "fr", None, 1, *clash),
        (7, "x", "fr", None, 1, *clash),
        (7, "another text under the same id", "fr", None, 30, *clash),
        (8, "ends with a surrogate pair \U0001f600 and combining e\u0301", "de", "c", 40, *clash),
        (None, None, None, None, None, *[None] * 7),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    """The same columns without a row."""
    return odd.filter("false")
