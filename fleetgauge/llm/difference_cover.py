"""Substring dedup with suffix arrays built by difference cover, over bytes.

Spark deals the windows that can repeat to groups (see ``repeats``). Each group builds one suffix array:
it names the triples at two of three positions, recurses on the names, sorts the third positions
by one byte and the rank after it, merges, and compares the prefixes of neighbours.

Defined results: a null text is empty. Rows with one doc_id are not before one another. A row without
doc_id keeps its bytes and takes none from others. Repeated rows each get a row of the result. An
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.common import BLOCK_CHARS, as_bytes, mixed, ranges, sha256_hex
from fleetgauge.llm.repeats import Plan, Symbols, covered, removed_windows

LENGTH, GRAM = 50, 24


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position, as one number; ``data`` has seven bytes to spare."""
    return np.lib.stride_tricks.as_strided(data.view(np.uint8)[: len(data) // 8 * 8].view("<u8"), (len(data) - 7,), (1,))


def bytes_of(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    parts = [as_bytes(t) for t in texts]
    return b"".join(parts), np.cumsum([len(p) for p in parts], dtype=np.int64)


def read_bytes(gram: int):
    loads = [*range(0, gram - 7, 8), gram - 8]

    def read(texts: list[str | None]) -> Symbols:
        data, ends = bytes_of(texts)
        eights = _eights(np.frombuffer(data + b"\0" * (16 - len(data) % 8), np.uint8))

        def grams(low: int, high: int) -> np.ndarray:
            x = np.zeros(high - low, np.uint64)
            for at in dict.fromkeys(loads):
                x = mixed(x + eights[low + at : high + at])
            return x

        return Symbols(grams, np.concatenate(([0], ends[:-1])), ends, lambda a, b: data[a:b])

    return read


def _at(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """x[i], and 0 past the end."""
    return np.where(i < len(x), x[np.minimum(i, len(x) - 1)], 0)


def _triples(text: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
    """One number for each triple, in the order of the triples; ``top`` is over every symbol."""
    if top < 1 << 21:
        return (_at(text, at) * top + _at(text, at + 1)) * top + _at(text, at + 2)
    pairs = np.unique(_at(text, at) * top + _at(text, at + 1), return_inverse=True)[1]
    return pairs * top + _at(text, at + 2)


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, the sorted keys, and for each sorted key how many are smaller."""
    order = np.argsort(keys, kind="stable")
    found = keys[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    return order, found, np.maximum.accumulate(np.where(new, np.arange(len(found)), 0)) if len(found) else order


def suffix_ranks(text: np.ndarray, depth: int, top: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Ranks from 0 of the ``wanted`` suffixes (sorted places; all by default), by their first ``depth`` symbols at least.

    Suffixes that agree so far may share a rank. ``text`` holds numbers from 1 and below ``top``. Triples at places 1
    and 2 of every three are named; their suffixes are ranked by recursion on the names, each of which
    stands for three symbols. Only ranks that the merge looks at are worked out.
    """
    n = len(text)
    wanted = np.arange(n) if wanted is None else wanted
    if not len(wanted):
        return np.zeros(0, np.int64)
    if depth <= 3 or n < 3:
        return np.unique(_triples(text, wanted, top), return_inverse=True)[1]
    ones, twos = np.arange(1, n, 3), np.arange(2, n, 3)
    class_of = wanted % 3
    zero, one, two = (wanted[class_of == k] for k in range(3))
    # a zero compares by its byte and the rank after it, or by two bytes and the rank after those
    looked = np.zeros(n + 3, bool)
    for places in (zero + 1, zero + 2, one, one + 1, two, two + 2):
        looked[places] = True
    values, names = np.unique(_triples(text, np.concatenate((ones, twos)), top), return_inverse=True)
    rank = np.zeros(n + 3, np.int64)
    asked = np.concatenate((ones[looked[ones]], twos[looked[twos]]))
    if len(values) == len(names):
        rank[np.concatenate((ones, twos))] = names + 1
    else:
        # a gap between the halves keeps a triple of the first from running into the second
        string = np.concatenate((names[: len(ones)] + 2, [1], names[len(ones) :] + 2))
        place = np.where(asked % 3 == 1, asked // 3, len(ones) + 1 + asked // 3)
        rank[asked] = suffix_ranks(string, -(-depth // 3), len(values) + 2, place) + 1
    size = int(rank.max()) + 1
    # merge: how many wanted suffixes of the other classes are smaller; two of them compare by what is ranked
    zero_order, zeros, own = _placed(text[zero] * size + rank[zero + 1])
    one_order, of_one, _ = _placed(text[one] * size + rank[one + 1])
    both = np.concatenate((zero, two))
    heads = text[both] * top + _at(text, both + 1)
    if top * top * size >= 1 << 62:
        heads = np.unique(heads, return_inverse=True)[1]
    zero_as_two = (heads[: len(zero)] * size + rank[zero + 2])[zero_order]
    two_order, of_two, _ = _placed(heads[len(zero) :] * size + rank[two + 2])
    sizes = np.bincount(rank[np.concatenate((one, two))], minlength=size + 1)
    before = np.cumsum(sizes) - sizes
    out = np.empty(n, np.int64)
    out[zero[zero_order]] = own + np.searchsorted(of_one, zeros) + np.searchsorted(of_two, zero_as_two)
    out[one[one_order]] = before[rank[one[one_order]]] + np.searchsorted(zeros, of_one)
    out[two[two_order]] = before[rank[two[two_order]]] + np.searchsorted(np.sort(zero_as_two), of_two)
    return out[wanted]


def _loads(length: int) -> list[int]:
    return list(dict.fromkeys([*range(0, length - 7, 8), length - 8]))


def equal_windows(contents: list[bytes], count: np.ndarray, several: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, int]:
    """A class for each window; windows are equal if and only if their classes are.

    Strings of one document whose windows all have hashes of their own repeat nothing and stay out of the array.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    data = np.frombuffer(b"\0".join(contents) + b"\0" * (8 + length + 8 - (int(sizes.sum()) + len(sizes) + length) % 8), np.uint8)
    data = data[: len(data) // 8 * 8]
    eights = _eights(data)
    starts = ranges(first, count)
    loads = _loads(length)
    hashes = np.zeros(len(starts), np.uint64)
    for offset in loads:
        hashes = mixed(hashes + eights[starts + offset])
    _, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(contents)), count)
    held = several | (np.bincount(owner, times[inverse] > 1, len(contents)) > 0)
    inside = held[owner]
    classes = np.empty(len(starts), np.int64)
    outside = int((~inside).sum())
    classes[~inside] = np.arange(outside)
    if inside.any():
        where = np.flatnonzero(held)
        text = data[ranges(first[where], sizes[where] + 1)].astype(np.int64) + 1
        moved = np.concatenate(([0], np.cumsum(sizes[where] + 1)[:-1]))
        rank = suffix_ranks(text, length, 258, ranges(moved, count[where]))
        order = np.argsort(rank, kind="stable")
        at = starts[inside][order]
        differs = np.zeros(len(at) - 1, bool)
        for offset in loads:
            differs |= eights[at[1:] + offset] != eights[at[:-1] + offset]
        own = np.empty(len(at), np.int64)
        own[order] = np.concatenate(([0], np.cumsum(differs)))
        classes[inside] = outside + own
    return classes, int(classes.max()) + 1 if len(classes) else 0


def remove_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_blocks: int = 4096, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, end exclusive), kept (the bytes left), kept_sha256.

    A byte goes if a string of ``length`` bytes (8 at least) around it also starts in a document with a smaller doc_id.
    """
    buckets = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plan = Plan(length, gram, read_bytes(gram), len, lambda c, n, s: equal_windows(c, n, s, length), hot_blocks, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts, answers = (batch.column(c)[i].as_py() for c in ("ids", "texts", "answers"))
                data, ends = bytes_of(texts)
                gone = covered(answers, length, len(data))
                whole = np.frombuffer(data, np.uint8)
                low, n_bytes, n_removed, spans, kept = 0, [], [], [], []
                for end in ends.tolist():
                    out = gone[low:end]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                    n_bytes.append(end - low)
                    n_removed.append(int(out.sum()))
                    spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                    kept.append(whole[low:end][~out].tobytes() if n_removed[-1] else data[low:end])
                    low = end
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(spans, span), pa.array(kept, pa.binary()), pa.array([sha256_hex(k) for k in kept])],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
                )

    return removed_windows(docs, plan, block_chars).select("ids", "texts", "answers").mapInArrow(
        run,
        "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string",
    )
