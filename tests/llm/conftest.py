import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, node long"


@pytest.fixture()
def documents(spark):
    """Makes a documents table with extra columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", 0.5, 7) for i, t, lang in rows], DOCS)

    return make


@pytest.fixture()
def odd(documents):
    """Nulls in id and text, empty, wordless, very long and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    return documents([
        (1, "the cat sat on the mat and looked at me", "en"), (1, "the cat sat on the mat and looked at me", "en"),
        (2, None, None), (3, "", "en"), (None, "der hund lief über die straße", "de"), (4, "?!  \n", None), (5, long, "en"), (6, "é", "fr"),
    ])
