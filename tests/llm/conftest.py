"""Small hand-made tables for the operators over documents."""

from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang, source) as a documents table."""

    def made(*rows):
        full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return made


@pytest.fixture
def awkward(documents):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "very long text with words " * 4000
    return documents(
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, long, "en", None),
        (5, "same words here twice and more of them", "en", "b"),
        (5, "same words here twice and more of them", "en", "b"),
        (6, "same words here twice and more of them", "de", "b"),
        (None, "no id has this row but it has some words", "en", "a"),
        (7, "ünï çødé 🙂 日本語 text", "de", "a"),
    )
