"""Texts and a fixture that the tests of this folder share."""

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns that clash with names inside the operators."""
    def make(rows, **extra):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score int, unit string"
        return spark.createDataFrame([(i, t, extra.get("lang", "en"), "s", len(t or ""), "r", 1, "u") for i, t in rows], schema)
    return make


#: Null, empty, blank, short, very long, tied and repeated texts.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "a null id has words too"), (5, "long " * 60_000), (6, "é ü ß 漢字 \U0001F600 end."),
       (7, "x" * 70_000), (8, "one two three four five six"), (9, "one two three four five six"), (10, "12 34 %% 56")]


def words_of(text, lower=False):
    b = (text or "").encode()
    return [w.decode() for w in (b.lower() if lower else b).split()]
