"""Benchmark items given twice, under one id with other texts, and without an id."""

import pytest

import brute
from fleetgauge.llm.decontaminate import search_benchmark, with_digest

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "red green blue grey black white pink brown gold silver"
ITEMS = [("a", PASSAGE)] * 40 + [("a", OTHER), ("b", "lone"), ("b", "lone"), ("c", PASSAGE), ("d", None), ("d", "")]
DOCS = [(1, f"x {PASSAGE} y"), (2, f"{OTHER} z {PASSAGE}"), (3, "Lone wolf"), (4, "nothing here"), (5, None), (6, OTHER)]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_an_item_counts_once(documents, spark, slice_bytes):
    items = spark.createDataFrame([(t, i, "row") for i, t in ITEMS], "text string, item_id string, doc_id string")
    found = search_benchmark(documents(DOCS), items, slice_bytes=slice_bytes)
    assert {tuple(r) for r in with_digest(found).collect()} == brute.contaminated(DOCS, ITEMS)
    longest = {r.doc_id: {m.item_id: (m.words, m["at"]) for m in r.matches} for r in found.collect()}
    assert longest[1] == {"a": (12, 1), "c": (12, 1)} and longest[2]["a"] == (12, 11) and longest[6] == {"a": (10, 0)}


def test_an_item_without_id(documents, spark):
    items = spark.createDataFrame([(None, PASSAGE), (None, PASSAGE)], "item_id string, text string")
    assert {tuple(r) for r in with_digest(search_benchmark(documents(DOCS), items)).collect()} == brute.contaminated(DOCS, [(None, PASSAGE)])
