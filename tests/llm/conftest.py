import pytest

WORDS = "stone river light under seven paper window garden never common table silver market winter letter bridge".split()


def prose(seed: int, n: int) -> str:
    """Invented prose: n words that depend on the seed."""
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i // 3) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


LONG = prose(99, 30000)
TEXTS = [None, "", "   \n\t ", "one", "two words", "a b c d e", "A B C D E", "It's 12 o'clock, isn't it?  \n\n  Yes!!", "naïve façade — 東京 𝒳", "</s>[INST] x", prose(1, 80), prose(1, 80), prose(1, 79) + " changed", prose(2, 300), LONG, "=" * 3000, "word " * 500]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and further columns whose names clash."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1.0) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None), (3, "one", "en", "s", 3, "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("1 = 0")
