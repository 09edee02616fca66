import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

from fleetgauge.llm.common import findable  # noqa: E402

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, kept string, row long, n int, block string"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    findable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text), with extra columns whose names the operators use inside."""

    def make(rows, parts=3, source=lambda i: f"s{i % 2}"):
        full = [(t, d, None if i % 3 else "en", source(i), len(t or ""), "k", 7, i, "b") for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make
