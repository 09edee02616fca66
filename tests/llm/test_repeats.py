import random

import numpy as np
import pytest

import brute
from corpora import awkward
from fleetgauge.llm import difference_cover, suffix_trees
from fleetgauge.llm.difference_cover import remove_repeated_bytes, suffix_ranks
from fleetgauge.llm.suffix_trees import SuffixTree, remove_repeated_words


def word_rows(df):
    return {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def byte_rows(df):
    return {(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot,chars", [(4096, 4_000_000), (1, 900), (2, 300)])
def test_words_and_bytes_equal_brute_force(documents, hot, chars):
    rows = awkward()
    df = documents(rows)
    assert word_rows(remove_repeated_words(df, hot_blocks=hot, block_chars=chars)) == brute.repeated_words(rows)
    assert byte_rows(remove_repeated_bytes(df, hot_blocks=hot, block_chars=chars)) == brute.repeated_bytes(rows)


def test_other_lengths(documents):
    rows = awkward(2)
    df = documents(rows)
    assert word_rows(remove_repeated_words(df, length=6, gram=3, block_chars=700)) == brute.repeated_words(rows, 6)
    assert byte_rows(remove_repeated_bytes(df, length=30, gram=12, block_chars=700)) == brute.repeated_bytes(rows, 30)


def test_a_text_longer_than_a_slice(documents, spark):
    pick = random.Random(4)
    long = " ".join(f"v{pick.randrange(5000)}" for _ in range(90_000))
    rows = [(1, long), (2, "start " + long[250_000:400_000]), (3, long)]
    got = byte_rows(remove_repeated_bytes(documents(rows, 1)))
    by_doc = {r[0]: r for r in got}
    assert by_doc[1][2] == 0 and by_doc[3][2] == len(long) and 149_900 < by_doc[2][2] <= 150_006


def test_ties_nulls_and_empty_tables(documents):
    same = " ".join(f"t{i}" for i in range(30))
    rows = [(5, same), (5, same), (None, same), (7, same), (7, same)]
    for found in (remove_repeated_words(documents(rows)), remove_repeated_bytes(documents(rows))):
        gone = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in found.collect()))
        assert gone == [(False, 5, False), (False, 5, False), (False, 7, True), (False, 7, True), (True, 0, False)]
    empty = documents([(1, "a")]).where("false")
    assert remove_repeated_words(empty).count() == 0 and remove_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("depth", [1, 3, 5, 20, 50])
def test_suffix_ranks_follow_the_order_of_suffixes(depth):
    pick = random.Random(depth)
    for _ in range(60):
        text = [pick.randrange(1, 4) for _ in range(pick.randrange(0, 70))]
        wanted = np.array(sorted(pick.sample(range(len(text)), len(text) // 2)), np.int64)
        rank = suffix_ranks(np.array(text, np.int64), depth, 5, wanted)
        for i, a in zip(wanted, rank):
            for j, b in zip(wanted, rank):
                if text[i : i + depth] < text[j : j + depth]:
                    assert a < b


def test_equal_windows_are_the_classes():
    pick = random.Random(9)
    for _ in range(60):
        length = pick.choice([8, 9, 13])
        count = [pick.randrange(1, 6) for _ in range(pick.randrange(1, 7))]
        strings = [[pick.choice([b"a", b"b"]) for _ in range(n + length - 1)] for n in count]
        for module, glue in ((suffix_trees, b" "), (difference_cover, b"")):
            classes, _ = module.equal_windows([glue.join(s) for s in strings], np.array(count), np.array([pick.random() < 0.3 for _ in count]), length)
            windows = [tuple(s[o : o + length]) for s, n in zip(strings, count) for o in range(n)]
            assert len(set(zip(windows, classes.tolist()))) == len(set(windows)) == len(set(classes.tolist()))


def test_nodes_of_a_suffix_tree():
    tree = SuffixTree([[b"a", b"b", b"a", b"b", b"c"]], np.array([0, 1, 2, 3]), 2)
    nodes = tree.deep_nodes(2)
    assert nodes[0] == nodes[2] and len(set(nodes.tolist())) == 3
