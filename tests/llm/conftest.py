import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard_id string, p long, root string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text, lang), with extra columns whose names clash with those of the operators."""

    def make(*rows):
        return spark.createDataFrame([(i, t, lang, "s", 0, "x", 1, "y") for i, t, lang in rows], DOC)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return docs((None, "hello there my friend", "en"), (1, None, None), (2, "", "en"), (3, "word " * 60_000, "en"), (4, "same text of some words here", "en"), (4, "same text of some words here", "en"), (5, "...", None))
