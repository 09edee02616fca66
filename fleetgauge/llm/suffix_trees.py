"""Substring dedup with prefix-partitioned suffix trees over words.

Suffixes are split by prefixes of variable length: the anchor gram of their window, or all of the
window where an anchor is very frequent (see ``repeats``). Each group fits the memory of a task,
and gets a suffix tree of its own. The inner nodes of string depth ``length`` or more are the repeats.

Defined results: a null or empty text has no words and loses none. Rows with one doc_id are not
before one another. A row without doc_id keeps its words and takes none from others. Repeated rows
each get a row of the result. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.common import BLOCK_CHARS, WordCodes, as_bytes, mixed, ranges, sha256_hex
from fleetgauge.llm.repeats import Plan, Symbols, covered, removed_windows

LENGTH, GRAM = 13, 5
_codes = WordCodes()


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of a block and where each text's end."""
    words: list[bytes] = []
    ends = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words += as_bytes(text).split()
        ends[i] = len(words)
    return words, ends


def read_words(gram: int):
    def read(texts: list[str | None]) -> Symbols:
        words, ends = words_of(texts)
        codes = _codes.of(words)
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
        joined = b" ".join(words)

        def grams(low: int, high: int) -> np.ndarray:
            x = codes[low:high]
            for i in range(1, gram):
                x = mixed(x + codes[low + i : high + i])
            return mixed(x)

        return Symbols(grams, np.concatenate(([0], ends[:-1])), ends, lambda a, b: joined[edges[a] : edges[b] - 1])

    return read


class SuffixTree:
    """The suffix tree of several word strings as sorted suffixes and their common prefixes.

    An inner node is an interval of neighbouring suffixes; its string depth is the least common
    prefix inside. Every string ends in a mark of its own, so no match runs from one into the next.
    """

    def __init__(self, strings: list[list[bytes]], suffixes: np.ndarray, depth: int) -> None:
        ids: dict[bytes, int] = {}
        marks = len(strings)
        flat: list[int] = []
        for i, words in enumerate(strings):
            flat += [marks + ids.setdefault(w, len(ids)) for w in words]
            flat.append(i)
        rank = np.array(flat, np.int64)
        levels = [rank]  # levels[k]: ranks of the first 2**k symbols
        while 1 << len(levels) <= depth:
            step = 1 << (len(levels) - 1)
            tail = np.zeros(len(rank), np.int64)
            tail[:-step] = rank[step:] + 1
            rank = np.unique(rank * (len(rank) + marks + len(ids) + 2) + tail, return_inverse=True)[1]
            levels.append(rank)
        # depth symbols: the longest power of two from the start, then the one that ends at depth
        step = 1 << (len(levels) - 1)
        second = rank[np.minimum(suffixes + depth - step, len(rank) - 1)]
        self.order = np.lexsort((second, rank[suffixes]))
        self.leaves = suffixes[self.order]
        self.common = self._common(levels, self.leaves, depth)

    @staticmethod
    def _common(levels: list[np.ndarray], leaves: np.ndarray, depth: int) -> np.ndarray:
        """Common prefix of each leaf and the one before, up to ``depth`` symbols."""
        a, b = leaves[:-1].copy(), leaves[1:].copy()
        found = np.zeros(len(a), np.int64)
        last = len(levels[0]) - 1
        for k in range(len(levels) - 1, -1, -1):
            for _ in range(2 if k == len(levels) - 1 else 1):
                same = levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)]
                found[same] += 1 << k
                a[same] += 1 << k
                b[same] += 1 << k
        return np.concatenate(([0], np.minimum(found, depth)))[: len(leaves)]

    def deep_nodes(self, depth: int) -> np.ndarray:
        """For each suffix, in the given order, its topmost node of at least ``depth``; single leaves count as nodes."""
        node = np.cumsum(self.common < depth) - 1
        out = np.empty(len(node), np.int64)
        out[self.order] = node
        return out


def equal_windows(contents: list[bytes], count: np.ndarray, several: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, int]:
    strings = [c.split(b" ") for c in contents]
    first = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])[:-1])).astype(np.int64)
    node = SuffixTree(strings, ranges(first, count), length).deep_nodes(length)
    return node, int(node.max()) + 1 if len(node) else 0


def remove_repeated_words(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_blocks: int = 4096, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space), kept_sha256.

    A word goes if a window of ``length`` words around it also starts in a document with a smaller doc_id.
    """
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = Plan(length, gram, read_words(gram), lambda c: c.count(b" ") + 1, lambda c, n, s: equal_windows(c, n, s, length), hot_blocks, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts, answers = (batch.column(c)[i].as_py() for c in ("ids", "texts", "answers"))
                words, ends = words_of(texts)
                gone = covered(answers, length, len(words))
                low, n_words, n_removed, kept = 0, [], [], []
                for end in ends.tolist():
                    part, out = words[low:end], gone[low:end]
                    n_words.append(end - low)
                    n_removed.append(int(out.sum()))
                    kept.append(b" ".join([w for w, x in zip(part, out.tolist(), strict=True) if not x] if n_removed[-1] else part))
                    low = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array([k.decode("utf-8", "surrogatepass") for k in kept]), pa.array([sha256_hex(k) for k in kept])],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return removed_windows(docs, plan, block_chars).select("ids", "texts", "answers").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    )
