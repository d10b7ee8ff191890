from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A table of (doc_id, text) rows with columns that clash with results."""

    def made(rows, partitions=3):
        full = [(i, t, "x", 7, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, n_tokens int, spans string, shard int").repartition(partitions)

    return made


#: Null, empty, blank, odd and repeated rows.
EDGES = [(None, None), (1, ""), (1, ""), (2, " \n\t"), (3, "é漢😀\x00ß\u0301"), (4, "a"), (4, "a"), (5, None), (6, "Ω ς Σ " * 40)]


@pytest.fixture(scope="session")
def edges():
    return EDGES
