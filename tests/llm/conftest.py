import pytest

ODD_TEXTS = [None, "", " ", "\n\n", "a", "A a\tA", "one two three", "x" * 5000, "word " * 3000, "<|endoftext|> é ü  z", "\x00 odd \x1f", "ß İ Σς", "tab\t\tx \r\n y"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeated rows, and clashing column names."""
    rows = [(i, t, "en", "src", None, None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, "again and again", None, None, 1, "p", 2), (7, "again and again", None, None, 1, "p", 2), (None, "no id", "de", None, 1, "p", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length long, part string, h long")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def row_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
