"""The audit of filters against one document after the other, in every order."""

from itertools import permutations

import pytest

from brute import WORD
from corpora import awkward
from fleetgauge.llm.filter_audit import audit_corpus, audit_filters

LABELS = "toxic int, doc_id long, quality int, part string, mask int"


def plain_failures(docs: list[tuple]) -> list[str]:
    least: dict = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    out = []
    for doc, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        failed += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        out.append(failed + "E" * (doc is not None and least[text] < doc))
    return out


def plain_audit(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    good = {d for t, d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for t, d, q, *_ in labels if t == 1 and d is not None}
    failures, rows, shapley = plain_failures(docs), [], {}
    for part in {s or "" for *_, s in docs}:
        mine = [(d, f) for (d, _, s), f in zip(docs, failures) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d, f in left if letter in f]
                failing = sum(letter in f for _, f in mine)
                left = [(d, f) for d, f in left if letter not in f]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                rows.append((part, order, step, len(left), len(gone), failing - len(gone), sum(f == letter for _, f in mine),
                             sum(d in good for d in gone), sum(d in toxic for d in gone)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows}


@pytest.fixture(scope="module")
def corpus():
    rows = [(d, t, "hot" if d % 3 else "b") for d, t in awkward(4)]
    rows += [(d, "COPY of a text # 1", "hot") for d in range(1000, 1030)] + [(d, "COPY of a text # 1", None) for d in (990, 1100)]
    rows += [(None, "COPY of a text # 1", "hot"), (None, "nobody", ""), (5, "again", "b"), (5, "again", "b"), (5, None, "b")]
    rows += [(2000, "Wort " * 60, "b"), (2001, "a" * 50_000 + " B", "hot"), (2002, "é |", "b"), (2003, "\x0b\x0c\x1c\x85 x", "b")]
    return rows


def test_all_orders(spark, corpus):
    labels = [(i % 4 == 0, d, i % 2, "p", 1) for i, (d, *_) in enumerate(corpus) if i % 3] + [(0, 1000, 0, "p", 1), (1, 1000, 1, "p", 1)]
    labels = [(int(t), *rest) for t, *rest in labels] + [(None, 1001, None, "p", 1), (1, None, 1, "p", 1)]
    docs = spark.createDataFrame([(s, d, t, 3, "x") for d, t, s in corpus], "source string, doc_id long, text string, mask int, good string")
    found = audit_corpus(docs.repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 3 * 600 and {tuple(r) for r in found} == plain_audit(corpus, labels)


def test_without_rows_and_labels(spark, corpus):
    docs = spark.createDataFrame([(s, d, t) for d, t, s in corpus], "source string, doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert {tuple(r) for r in audit_corpus(docs, none).collect()} == plain_audit(corpus, [])
    assert audit_corpus(docs.where("false"), none).count() == 0


def test_any_letters(spark):
    cells = spark.createDataFrame([("p", 1, 5, 1, 0), ("p", 3, 2, 0, 2), ("p", 0, 4, 4, 0)], "part string, mask int, documents long, good long, toxic long")
    found = {(r.filter_order, r.step): r for r in audit_filters(cells, "XY").collect()}
    assert (found["XY", 1].removed, found["XY", 2].removed, found["XY", 2].redundant, found["YX", 2].removed) == (7, 0, 2, 5)
    assert found["XY", 1].shapley == 12 and found["YX", 2].toxic_lost == 0 and found["XY", 1].toxic_lost == 2
    for wrong in ("", "XX", "ABCDEFG"):
        with pytest.raises(ValueError):
            audit_filters(cells, wrong)
