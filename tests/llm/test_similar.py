import random

import pytest

import brute
from corpora import awkward
from fleetgauge.llm.similar import CellLimits, components, keep_first, near_duplicates


def found_rows(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def crowd(seed=5):
    """Overlapping groups of near copies, so that chains of links and pairs just below the limit occur."""
    pick = random.Random(seed)
    base = [[f"w{pick.randrange(400)}" for _ in range(pick.randrange(20, 90))] for _ in range(6)]
    rows = []
    for i in range(250):
        text = list(pick.choice(base))
        for _ in range(pick.randrange(0, 6)):
            text[pick.randrange(len(text))] = f"x{pick.randrange(50)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("limits", [CellLimits(), CellLimits(7, 300)])
def test_components_equal_brute_force(documents, limits):
    rows = [*crowd(), (900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c")]
    expected = brute.near_components(rows)
    assert found_rows(near_duplicates(documents(rows), limits, block_chars=3000)) == expected
    kept = keep_first(documents(rows), limits=limits)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in expected})


def test_awkward_texts(documents):
    rows = awkward()
    df = documents(rows)
    assert found_rows(near_duplicates(df, block_chars=900)) == brute.near_components(rows)
    assert keep_first(df).columns == df.columns


def test_ties_nulls_and_empty_tables(documents):
    text = "one two three four five six seven"
    rows = [(3, text), (3, text), (3, text + " eight nine ten"), (None, text), (8, None), (8, None), (None, "")]
    found = near_duplicates(documents(rows)).collect()
    assert len(found) == 7 and {r.component_id for r in found if r.n_shingles == 3} == {3}
    kept = keep_first(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("3", text), ("3", text + " eight nine ten")]
    assert sum(r.text is None for r in kept) == 1 and sum(r.text == "" for r in kept) == 1
    empty = documents([(1, "a")]).where("false")
    assert near_duplicates(empty).count() == 0 and keep_first(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 150)]
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100), (200, 150), (150, 150)}
