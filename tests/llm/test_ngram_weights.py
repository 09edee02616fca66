"""Counts, ratios and scores of the toxicity model against sets of n-grams, text by text."""

import math
import random

import numpy as np
import pytest

from fleetgauge.llm import toxicity
from fleetgauge.llm.toxicity import count_ngrams, fit, held_out, log_count_ratios, score_documents

LABELS = "doc_id long, toxic int"


def grams(text: str) -> set[int]:
    """Hashes of the n-grams of a text, one after the other."""
    text = " " + " ".join((text or "").lower().split()) + " "
    found = set()
    for order in toxicity.ORDERS:
        for i in range(len(text) - order + 1):
            found.add(int(toxicity._hashes(np.array([ord(c) for c in text[i : i + order]], "<u4"), order)[0]))
    return found


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(2)
    rows = [(i, " ".join(pick.choice(["calm", "lake", "stone", "walks", "über"]) for _ in range(12)) + (f" zorgl{i % 3}" if i % 4 == 0 else "")) for i in range(240)]
    rows += [(300, None), (301, ""), (302, "zorgl0"), (303, "ZORGL1  zorgl2")]
    return rows, [(i, int(i % 4 == 0)) for i, _ in rows[:240]] + [(1, 7), (2, None), (900, 1)]


def test_counts_and_ratios(documents, corpus, spark):
    rows, labels = corpus
    said = {d: t for d, t in labels if d < 240 and t in (0, 1)}
    train = [(grams(t), said[d]) for d, t in rows if d in said and not held_out(d)]
    df = spark.createDataFrame([(t, said[d]) for d, t in rows if d in said and not held_out(d)], "text string, toxic int").repartition(5)
    counts, kinds = count_ngrams(df)
    assert kinds.tolist() == [sum(t == k for _, t in train) for k in (0, 1)]
    met = set().union(*(g for g, _ in train))
    assert set(np.flatnonzero(counts.any(axis=0)).tolist()) == met
    ratio, apart = log_count_ratios(counts, kinds)
    for h in sorted(met)[::7]:
        others, toxic = (sum(h in g for g, t in train if t == k) for k in (0, 1))
        assert counts[:, h].tolist() == [others, toxic]
        p, q = (toxic + 0.5) / (kinds[1] + 1), (others + 0.5) / (kinds[0] + 1)
        assert ratio[h] == pytest.approx(math.log(p / q))
        assert apart[h] == pytest.approx(abs(p - q) / math.sqrt((p + q) * (1 / kinds[0] + 1 / kinds[1])))


def test_every_significant_ngram_weighs(documents, corpus, spark):
    rows, labels = corpus
    df, label_df = documents(rows), spark.createDataFrame(labels, LABELS)
    model = fit(df, label_df)
    said = [(d, t) for d, t in labels if d < 240 and t in (0, 1)]
    texts = dict(rows)
    train = spark.createDataFrame([(texts[d], t) for d, t in said if not held_out(d)], "text string, toxic int")
    ratio, apart = log_count_ratios(*count_ngrams(train))
    assert set(np.flatnonzero(model.weights)) <= set(np.flatnonzero(apart >= toxicity.EVIDENCE))
    distinctive = set.intersection(*(grams(f"zorgl{k} ") for k in range(3))) - grams("calm lake stone walks über")
    assert distinctive and all(model.weights[h] > 0 for h in distinctive)
    found = {r.doc_id: r for r in score_documents(df, model).collect()}
    for d, t in rows:
        total = model.intercept + sum(float(model.weights[h]) for h in grams(t))
        assert found[d].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6) and found[d].predicted == int(found[d].score >= 0.5)
    assert found[300].score == pytest.approx(found[301].score) and found[302].predicted == found[303].predicted == 1
    assert {found[d].predicted == t for d, t in said} == {True}


def test_copies_fill_no_sample_and_order_does_not_matter(documents, corpus, spark):
    rows, labels = corpus
    label_df = spark.createDataFrame(labels, LABELS)
    one, other = fit(documents(rows, parts=1), label_df, max_rows=20), fit(documents(rows[::-1], parts=7), label_df, max_rows=20)
    assert np.array_equal(one.weights, other.weights) and one.intercept == other.intercept
    hot = rows + [rows[1]] * 200  # one labelled row many times over
    assert toxicity._sample(
        documents(hot).select("doc_id", "text").join(label_df.where("toxic in (0, 1)"), "doc_id"), 50
    ).count() <= 100
