"""Repeated windows of symbols across documents: the exchange that substring dedup is built on.

A window is ``length`` consecutive symbols (words or bytes) of one document. To find equal windows
without sending every suffix, each window is named by its *anchor*: the gram of ``gram`` symbols
with the least hash inside it. Equal windows have equal anchors, so no pair can be missed.

1. Each block sends the hashes of its distinct anchors, five bytes each, to hash buckets; a bucket
   answers which of them occur in two documents or more. (Two anchors of one hash only add work.)
2. Runs of consecutive windows with one live anchor are sent, once a block, with their symbols to
   the bucket of the anchor. There a suffix structure over the distinct runs finds equal windows and the least
   document of each; it compares the symbols themselves. An anchor in very many blocks has a longer prefix
   instead: each of its windows goes by all its ``length`` symbols, so no frequent phrase gathers in one place.
3. A bucket answers each block with the window starts that a smaller document has as well.

A window that a third of all documents share arrives once a block, not once a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import mixed, ranges, sliding_min, store_blocks

SLICE = 1 << 18
LOW40 = np.uint64((1 << 40) - 1)
POSITION = np.uint64((1 << 20) - 1)
SENT = "bucket int, block long, body binary"
ANSWER = "block long, bucket int, body binary"


@dataclass(frozen=True)
class Symbols:
    """A block as symbols. ``ends[d]`` is where document d ends; ``cut(a, b)`` are the bytes of symbols a…b-1."""

    grams: Callable[[int, int], np.ndarray]  # hashes of the grams that start in a…b-1, inside one slice
    starts: np.ndarray
    ends: np.ndarray
    cut: Callable[[int, int], bytes]


@dataclass(frozen=True)
class Plan:
    length: int
    gram: int
    read: Callable[[list[str | None]], Symbols]
    symbols: Callable[[bytes], int]  # how many a string has
    equal_windows: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, int]]  # strings, their windows, whether two documents have them
    hot_blocks: int = 4096
    buckets: int = 64


@dataclass(frozen=True)
class Runs:
    """Consecutive windows with one anchor: first window, number, hash of the anchor, document in the block."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


def runs_of(symbols: Symbols, plan: Plan) -> Runs:
    """Windows are cut into slices first, so that a very long document needs no more memory than a short one."""
    width = plan.length - plan.gram + 1
    parts: list[tuple[np.ndarray, ...]] = []
    ends = symbols.ends
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, max(0, total - plan.length + 1), SLICE):
        high = min(low + SLICE, total - plan.length + 1)
        grams = symbols.grams(low, high + width - 1)
        keyed = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min(keyed, width) & POSITION).astype(np.int64)
        window = np.arange(low, high)
        doc = np.searchsorted(ends, window, "right")
        whole = window + plan.length <= ends[doc]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
        first = np.flatnonzero(change & whole)
        borders = np.flatnonzero(change | ~whole)
        after = np.searchsorted(borders, first, "right")
        stop = np.where(after < len(borders), borders[np.minimum(after, len(borders) - 1)], len(at)) if len(borders) else first
        parts.append((first + low, stop - first, grams[at[first]], doc[first]))
    if not parts:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none.astype(np.uint64), none)
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _distinct(runs: Runs, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a block ordered by (bucket, low bits); where each run's is; whether two documents have it."""
    key = (_bucket(runs.anchor, buckets).astype(np.uint64) << np.uint64(40)) | (runs.anchor & LOW40)
    values, inverse = np.unique(key, return_inverse=True)
    low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), -1)
    np.minimum.at(low, inverse, runs.doc)
    np.maximum.at(high, inverse, runs.doc)
    return values & LOW40, (values >> np.uint64(40)).astype(np.int64), inverse, low < high


def _rows(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _send_anchors(plan: Plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
                values, bucket, _, several = _distinct(runs_of(plan.read(texts.as_py()), plan), plan.buckets)
                edges = np.searchsorted(bucket, np.arange(plan.buckets + 1))
                rows = [
                    (b, block, _five(values[x:y]) + np.packbits(several[x:y]).tobytes())
                    for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y
                ]
                if rows:
                    yield _rows(["bucket", "block", "body"], rows, [pa.int32(), pa.int64(), pa.binary()])

    return run


def _count_of(size: int) -> int:
    """How many anchors a message of ``size`` bytes holds: five bytes and a bit each."""
    n = size * 8 // 41
    while 5 * n + (n + 7) // 8 < size:
        n += 1
    return n


def _judge_anchors(plan: Plan) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        bodies = rows.column("body").to_pylist()
        counts = [_count_of(len(b)) for b in bodies]
        values = np.concatenate([_wide(b[: 5 * n]) for b, n in zip(bodies, counts, strict=True)])
        several = np.concatenate([
            np.unpackbits(np.frombuffer(b[5 * n :], np.uint8), count=n) for b, n in zip(bodies, counts, strict=True)
        ])
        found, inverse = np.unique(values, return_inverse=True)
        blocks = np.bincount(inverse, minlength=len(found))
        live = (blocks > 1) | (np.bincount(inverse, several, len(found)) > 0)
        live, hot = live[inverse], (blocks >= plan.hot_blocks)[inverse]
        edges = np.concatenate(([0], np.cumsum(counts)))
        answers = [
            np.packbits(live[x:y]).tobytes() + np.packbits(hot[x:y]).tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)
        ]
        return pa.table({
            "block": rows.column("block").combine_chunks(), "bucket": rows.column("bucket").combine_chunks(),
            "body": pa.array(answers, pa.binary()),
        })

    return run


def _pack(*arrays: bytes) -> bytes:
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(arrays))


def _unpack(body: bytes, count: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(body)
    sizes = np.frombuffer(data[: 4 * count], "<u4")
    edges = 4 * count + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return [data[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]


def _send_runs(plan: Plan) -> Callable:
    def of_block(block: int, ids: list, texts: list, answers: list) -> list[tuple]:
        symbols = plan.read(texts)
        runs = runs_of(symbols, plan)
        values, bucket, inverse, _ = _distinct(runs, plan.buckets)
        flags = np.zeros((2, len(values)), bool)
        edges = np.searchsorted(bucket, np.arange(plan.buckets + 1))
        for a in answers:
            x, y = edges[a["bucket"]], edges[a["bucket"] + 1]
            bits = np.frombuffer(a["body"], np.uint8)
            flags[0, x:y] = np.unpackbits(bits[: len(bits) // 2], count=y - x)
            flags[1, x:y] = np.unpackbits(bits[len(bits) // 2 :], count=y - x)
        live = np.flatnonzero(flags[0][inverse])
        hot = flags[1][inverse][live]
        start, count, doc, to = runs.start[live], runs.count[live], runs.doc[live], bucket[inverse[live]]
        if hot.any():  # each window by itself, by all its symbols
            each = ranges(start[hot], count[hot])
            owner = np.repeat(doc[hot], count[hot])
            start, doc = np.concatenate((start[~hot], each)), np.concatenate((doc[~hot], owner))
            count = np.concatenate((count[~hot], np.ones(len(each), np.int64)))
            to = np.concatenate((to[~hot], np.full(len(each), -1)))
        sent: dict[int, tuple[dict, list, list, list]] = {}
        known = np.array([i is not None for i in ids], bool)
        numbers = np.array([0 if i is None else i for i in ids], np.int64)
        cut, length = symbols.cut, plan.length
        for s, n, d, b in zip(start.tolist(), count.tolist(), doc.tolist(), to.tolist(), strict=True):
            if not known[d]:
                continue
            content = cut(s, s + n + length - 1)
            if b < 0:
                b = xxhash.xxh3_64_intdigest(content) % plan.buckets
            contents, which, starts, docs = sent.setdefault(b, ({}, [], [], []))
            which.append(contents.setdefault(content, len(contents)))
            starts.append(s)
            docs.append(d)
        rows = []
        for b, (contents, which, starts, docs) in sent.items():
            body = _pack(
                b"".join(contents), np.array([len(c) for c in contents], "<u4").tobytes(), np.array(which, "<u4").tobytes(),
                np.array(starts, "<u4").tobytes(), numbers[docs].astype("<i8").tobytes(),
            )
            rows.append((b, block, body))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, texts, answers = (batch.column(c)[i].as_py() for c in ("block", "ids", "texts", "answers"))
                if rows := of_block(block, ids, texts, answers or []):
                    yield _rows(["bucket", "block", "body"], rows, [pa.int32(), pa.int64(), pa.binary()])

    return run


def _judge_runs(plan: Plan) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        contents: dict[bytes, int] = {}
        per_block = []
        for block, body in zip(rows.column("block").to_pylist(), rows.column("body").to_pylist(), strict=True):
            text, sizes, which, starts, docs = _unpack(body, 5)
            edges = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64))).tolist()
            own = [contents.setdefault(text[x:y], len(contents)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            per_block.append((
                block, np.array(own, np.int64)[np.frombuffer(which, "<u4")], np.frombuffer(starts, "<u4").astype(np.int64),
                np.frombuffer(docs, "<i8"),
            ))
        content = np.concatenate([x[1] for x in per_block])
        start = np.concatenate([x[2] for x in per_block])
        doc = np.concatenate([x[3] for x in per_block])
        strings = list(contents)
        count = np.array([plan.symbols(c) for c in strings], np.int64) - plan.length + 1
        least, most = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
        np.minimum.at(least, content, doc)
        np.maximum.at(most, content, doc)
        # classes: a number for each window of each distinct run, equal for equal windows
        owner = np.repeat(np.arange(len(strings)), count)
        classes, size = plan.equal_windows(strings, count, least < most)
        smallest = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(smallest, classes, least[owner])
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        block = np.repeat(np.arange(len(per_block)), [len(x[1]) for x in per_block])
        later = least[content] < doc  # a smaller document has all of the run
        own = np.flatnonzero(~later)
        each = ranges(first[content[own]], count[content[own]])
        mine = np.repeat(own, count[content[own]])
        gone = smallest[classes[each]] < doc[mine]
        each, mine = each[gone], mine[gone]
        at = start[mine] + each - first[content[mine]]
        head = np.ones(len(at), bool)
        head[1:] = (mine[1:] != mine[:-1]) | (each[1:] != each[:-1] + 1)
        heads = np.flatnonzero(head)
        run_start = np.concatenate((start[later], at[heads]))
        run_count = np.concatenate((count[content[later]], np.diff(np.append(heads, len(at)))))
        of_block = np.concatenate((block[later], block[mine[heads]]))
        order = np.lexsort((run_start, of_block))
        run_start, run_count, of_block = run_start[order], run_count[order], of_block[order]
        edges = np.searchsorted(of_block, np.arange(len(per_block) + 1))
        found = [
            (per_block[b][0], 0, _pack(run_start[x:y].astype("<u4").tobytes(), run_count[x:y].astype("<u4").tobytes()))
            for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y
        ]
        return pa.Table.from_batches([_rows(["block", "bucket", "body"], found, [pa.int64(), pa.int32(), pa.binary()])])

    return run


def _answers(replies: DataFrame, buckets: int) -> DataFrame:
    """One row a block, dealt as the stored blocks are."""
    return replies.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("answers"))


def removed_windows(docs: DataFrame, plan: Plan, block_chars: int) -> DataFrame:
    """Rows (block, ids, texts, answers): each answer's body packs runs (first start, number) of windows that a smaller document has too."""
    blocks, buckets = store_blocks(docs, block_chars)
    anchors = blocks.select("block", "texts").mapInArrow(_send_anchors(plan), SENT)
    live = anchors.groupBy("bucket").applyInArrow(_judge_anchors(plan), ANSWER)
    asked = blocks.join(_answers(live, buckets).hint("shuffle_hash"), "block")
    runs = asked.mapInArrow(_send_runs(plan), SENT)
    gone = runs.groupBy("bucket").applyInArrow(_judge_runs(plan), ANSWER)
    return blocks.join(_answers(gone, buckets).hint("shuffle_hash"), "block", "left")


def covered(answers: list | None, length: int, total: int) -> np.ndarray:
    """Which of ``total`` symbols lie in a removed window."""
    change = np.zeros(total + 1, np.int32)
    for a in answers or []:
        start, count = (np.frombuffer(x, "<u4").astype(np.int64) for x in _unpack(a["body"], 2))
        np.add.at(change, start, 1)
        np.add.at(change, start + count - 1 + length, -1)
    return np.cumsum(change[:-1]) > 0


__all__ = ["Plan", "Runs", "Symbols", "covered", "mixed", "removed_windows", "runs_of"]
