"""Lattice scores against the sum over listed segmentations, and word scores against plain counts."""

import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import public_tokenizers
import pytest

from corpora import awkward
from fleetgauge.llm import lattice_lm
from fleetgauge.llm.lattice_lm import END, Lattice, score_documents, vocabulary

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text: bytes, pieces: dict[bytes, float]):
    if not text:
        yield ()
    for end in range(1, len(text) + 1):
        if text[:end] in pieces:
            yield from ((text[:end], *rest) for rest in segmentations(text[end:], pieces))


def is_held(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def plain_model(rows: list[tuple], rounds: int) -> tuple[dict[bytes, float], float, Counter]:
    """Piece log probabilities, end's, and training counts; every segmentation of every word written out."""
    trained = Counter(w for d, t in rows if not is_held(d) for w in [*(t or "").encode().lower().split(), END])
    weights: dict[bytes, float] = {}
    for piece, weight in vocabulary(PIECES):
        weights[piece] = weights.get(piece, 0.0) + exp(weight)
    least = min(weights.values())
    total = sum(weights.values()) + least
    weights, end = {p: w / total for p, w in weights.items()}, least / total
    for _ in range(rounds):
        uses = Counter()
        for word, times in trained.items():
            if word != END:
                ways = [(s, exp(sum(log(weights[p]) for p in s))) for s in segmentations(END + word, weights)]
                whole = sum(p for _, p in ways)
                for pieces, p in ways:
                    for piece in pieces:
                        uses[piece] += times * p / whole
        total = sum(uses.values()) + trained[END] + len(weights) + 1
        weights, end = {p: (uses[p] + 1) / total for p in weights}, (trained[END] + 1) / total
    return weights, end, trained


def plain_scores(rows, rounds):
    weights, end, trained = plain_model(rows, rounds)
    n, v = sum(trained.values()), sum(c > 0 for c in trained.values())
    out = []
    for d, t in rows:
        words = (t or "").encode().lower().split()
        score = log10(end)
        for w in words:
            score += log10(sum(exp(sum(log(weights[p]) for p in s)) for s in segmentations(END + w, weights)))
        base = sum(log10((trained[w] + 1) / (n + v + 1)) for w in [*words, END])
        out.append((d, is_held(d), len(words) + 1, sum(trained[w] > 0 for w in [*words, END]), n, base, score))
    return out


def close(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


ROWS = [
    (i, t) for i, t in enumerate(["The cat", "the  CAT sat", None, "", "naïve café", "ÉÜ é", "the 日本 x", "a\tb\nc\x0bd", "in the", "on the", "zzz q", "the"] * 2)
] + [(None, "no id"), (3, "again the"), (3, "again the")]


@pytest.mark.parametrize("rounds", [1, 2])
def test_scores_of_a_table(documents, monkeypatch, rounds):
    expected = plain_scores(ROWS, rounds)
    close(score_documents(documents(ROWS), PIECES, rounds).collect(), expected)
    monkeypatch.setattr(lattice_lm, "HOT_SHARE", 8)  # most words go to their counts by the join
    close(score_documents(documents(ROWS), PIECES, rounds).collect(), expected)


def test_a_document_is_its_words_in_a_row(monkeypatch):
    lattice = Lattice.of([(p, w - 10) for p, w in vocabulary(PIECES)])
    text = b" the cat sat na\xc3\xafvely \xf0\x9f\x98\x80"
    words = [b" " + w for w in text.split()]
    assert lattice.log_probabilities([text])[0] == pytest.approx(lattice.log_probabilities(words).sum())
    monkeypatch.setattr(lattice_lm, "BATCH_BYTES", 5)
    assert lattice.log_probabilities([text])[0] == pytest.approx(lattice.log_probabilities(words).sum())
    known = dict(zip(lattice.pieces, np.exp(lattice.weights)))
    listed = [(s, np.prod([known[p] for p in s])) for s in segmentations(b" theca", known)]
    total = sum(p for _, p in listed)
    assert lattice.log_probabilities([b" theca"])[0] == pytest.approx(log(total))
    uses = Counter()
    for ways, p in listed:
        for piece in ways:
            uses[piece] += 3 * p / total
    found = lattice.expected([b" x", b" theca"], np.array([0, 3])) / lattice_lm.UNIT
    assert {p: found[i] for i, p in enumerate(lattice.pieces) if found[i] > 1e-4} == pytest.approx({p: n for p, n in uses.items() if n > 1e-4}, abs=1e-4)


def test_long_words_hot_words_and_nothing(documents):
    long = "x" * 5000 + "é"
    rows = [(i, f"{long} same same") for i in range(40)] + [(50, "y" * 64), (51, "y" * 65), (52, "y" * 65)]
    found = {r.doc_id: r for r in score_documents(documents(rows), PIECES).collect()}
    trains = [d for d, _ in rows if not is_held(d)]
    assert found[0].train_tokens == sum(4 if d < 50 else 2 for d in trains) and all(r.n_known == r.n_tokens for r in found.values() if r.doc_id < 50)
    assert len({r.score for r in found.values() if r.doc_id < 50}) == 1 and found[0].score < found[51].score < 0
    held = [d for d in range(300) if is_held(d)]
    alone = score_documents(documents([(d, "only held") for d in held]), PIECES).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in alone} == {(3, 0, 0, 0.0)} and alone[0].score < 0
    assert score_documents(documents([(1, "a")]).where("false"), PIECES).count() == 0


def test_probabilities_of_words_add_up(documents):
    """The model spreads no more than the whole: words of one letter and the end, under the learned weights."""
    docs = documents([(d, t) for d, t in awkward(2, 30)])
    model = lattice_lm.learn(docs.select("text", lattice_lm.held_out(docs["doc_id"]).alias("held")), PIECES)
    assert np.exp(model.lattice.weights).sum() + exp(model.end) == pytest.approx(1)
