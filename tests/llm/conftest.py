import pytest

TEXTS = [
    None, "", "   ", "a", "A b", "a  b\n", "ab", "the quick brown fox", "the quick brown fox", "The quick\tbrown fox", "x" * 3000, "x" * 3000,
    "naïve café — 日本語 🙂 'tis 12345 it's", "<|endoftext|> and <|startoftext|>", "tab\there\r\nand  two  spaces ", "word " * 900, "lorem ipsum dolor " * 60, "lorem ipsum dolor " * 60 + "tail",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those of operators."""
    rows = [(i, t, "en", i % 3) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en", 1), (None, "a null id", "en", 2), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").selectExpr("doc_id", "text", "lang", "n", "n AS kept", "lang AS sha", "n AS component_id")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
