"""Shared helpers: frames with awkward rows, and the session settings that Python workers need."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_row` string, `Copies` int, `a.b` string"


@pytest.fixture
def docs(spark):
    """documents-shaped frames with clashing extra columns from (doc_id, text, source) rows."""
    from weftwork.llm.common import ready

    ready(spark)

    def build(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 7, "y") for i, t, s in rows], DOCS)
    return build


AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "one two three four five six", "a"), (4, "one two three four five six", "a"),
    (4, "one two three four five six", "a"), (5, "x", "b"), (6, "word " * 30_000, "b"), (7, "ONE two Three four five SIX", None), (8, "é ü   \x1c z", "é"),
]


@pytest.fixture
def awkward():
    return AWKWARD
