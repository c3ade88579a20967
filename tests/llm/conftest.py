import re

import pytest

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    """The words of the contract, by hand."""
    return WORD.findall((text or "").encode().lower() if text is not None else b"")


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a frame of documents, with columns whose names clash with those of results."""

    def make(rows):
        frame = spark.createDataFrame([(i, t, "en", "s", None, "own", 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rule string, score double")
        return frame.selectExpr("*", "1 as n_words", "2 as size", "3 as shard", "4 as kept", "5 as row", "6 as k", "7 as t", "'x' as spans", "8 as mean")

    return make


LONG = "alpha beta gamma delta epsilon " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "!!! ???"), (5, "Ünïcode straße Éa"), (6, LONG), (7, "one two three"), (7, "one two three"), (None, "no id here"), (8, "\U0001f600 x")]
