import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import DOCS, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    rows = [
        (1, prose(1), "en", "a"), (1, prose(1), "en", "a"), (2, prose(1), "en", "b"), (3, None, "en", "a"), (4, "", "en", "a"), (None, prose(4), "en", "a"),
        (5, prose(5), None, None), (6, "\n \n", "de", "b"), (7, prose(7, 30_000), "en", "a"), (8, "?!", "en", "b"), (1, prose(9), "en", "a"), (9, "é" * 50, "fr", "b"),
    ]
    full = [(*r, len(r[1]) if r[1] is not None else None, 7, "x", -1) for r in rows]
    return spark.createDataFrame(full, DOCS + ", dropped_lines int, kept string, tokens int").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
