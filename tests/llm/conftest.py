from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a long text, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977} filler{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "alpha beta"), (4, "alpha beta"), (5, "Alpha  beta"), (6, long), (7, long + " x"), (8, "Ünïcode 東京 \U0001f600 text"), (9, "alphabeta")]
    return spark.createDataFrame([(i, t, "score", 7, "kept", 0) for i, t in rows], "doc_id long, text string, score string, n_words int, kept string, id int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, n_words int, kept string, id int")
