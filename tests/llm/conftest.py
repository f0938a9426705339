from __future__ import annotations

import pytest

#: Names that operators use inside, as columns of the input.
CLASHES = ("fp", "key", "route", "kind", "word", "n", "ids", "entities", "host", "verdict", "score", "lang_pred", "window", "form", "marked", "root", "node", "d2", "kept", "n_words", "anchor", "hash")
LONG = " ".join(f"word{k % 997} and{k % 13}" for k in range(40_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, and clashing columns."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "a"), (5, "x", "fr", "b"), (None, "no id here, but text", "en", "a"), (None, None, None, None),
        (6, LONG, "en", "b"), (7, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a"), (7, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a"), (8, "ünïcödé 字 \U0001f600 text\x00 with nul", "de", "a"), (9, "12345 !!! ???", "es", "b"),
    ]
    rows = [(*t, len(t[1] or ""), *(["clash"] * len(CLASHES))) for t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
