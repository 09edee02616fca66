"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each shard of documents gets a suffix array over its words. Every suffix of every benchmark item is searched in it
by binary search, word by word, which gives the places where the item's windows stand, and the longest verbatim
matches. Documents never leave their shard: a document longer than a shard is cut into
overlapping pieces, whose hits are put together in the same task.

The benchmark is held by each task; its size is checked first, and a larger one is searched in slices of
``slice_bytes``, whose hits are joined by document.

Defined results: a null or text without words is not contaminated, and an item without words matches nothing.
An item without id is named by the empty string. Repeated rows each get a row; items with equal text all count.
Empty tables give empty results or no hits. Extra columns are ignored, or pass through ``remove_contaminated``.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import WordCodes, as_bytes, keyed, ranges, small, written

WINDOW = 10
SHARD_WORDS = 400_000
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_OTHERS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_UPPER + _OTHERS, _LOWER + b" " * len(_OTHERS))
_codes = WordCodes()
MATCH = "item_id: string, words: int, at: long"
FOUND = f"row long, doc_id long, n_words long, spans array<struct<start: long, end: long>>, matches array<struct<{MATCH}>>"


def words_of(text: str | None) -> list[bytes]:
    return as_bytes(text).translate(_TABLE).split()


@dataclass(frozen=True)
class Items:
    """Benchmark words as ranks in a vocabulary, and the suffixes to search: where, in which item, how many words must match."""

    vocabulary: np.ndarray
    words: np.ndarray
    start: np.ndarray
    need: np.ndarray
    item: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int) -> Items:
        codes, start, need, item, at = [], [], [], [], 0
        for i, (_, text) in enumerate(rows):
            own = _codes.of(words_of(text))
            last = max(1, len(own) - window + 1) if len(own) else 0
            start.append(np.arange(at, at + last))
            need.append(np.full(last, min(window, len(own))))
            item.append(np.full(last, i))
            codes.append(own)
            at += len(own)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        vocabulary, words = np.unique(join(codes, np.uint64), return_inverse=True)
        return cls(vocabulary, words + 1, join(start, np.int64), join(need, np.int64), join(item, np.int64), [n or "" for n, _ in rows])


class SuffixArray:
    """Suffixes of a shard, sorted by their first ``depth`` words or more. Words outside the vocabulary have rank 0."""

    def __init__(self, ranks: np.ndarray, depth: int) -> None:
        self.ranks = np.concatenate((ranks, [0]))
        order, step = ranks, 1
        while step < depth:
            after = np.zeros_like(order)
            after[:-step] = order[step:] + 1
            values, order = np.unique(order * (int(order.max(initial=0)) + 2) + after, return_inverse=True)
            step *= 2
            if len(values) == len(order):
                break
        self.sorted = np.argsort(order, kind="stable")

    def _edge(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, above: bool) -> np.ndarray:
        """The first suffix in low…high-1 whose word at ``depth`` is not smaller, or is greater, than ``word``."""
        low, high = low.copy(), high.copy()
        last = len(self.ranks) - 1
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            at = np.minimum(self.sorted[np.minimum(middle, last - 1)] + depth, last)
            right = self.ranks[at] <= word if above else self.ranks[at] < word
            low = np.where(open_ & right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Places where a needed length of an item's suffix stands: (position, suffix)."""
        active = np.arange(len(items.start))
        low, high = np.zeros(len(active), np.int64), np.full(len(active), len(self.sorted))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 0
        while len(active):
            word = items.words[items.start[active] + depth]
            low, high = self._edge(low, high, depth, word, False), self._edge(low, high, depth, word, True)
            depth += 1
            full, some = items.need[active] == depth, low < high
            hit = full & some
            done.append((active[hit], low[hit], high[hit]))
            stay = some & ~full
            active, low, high = active[stay], low[stay], high[stay]
        suffix, low, high = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        return self.sorted[ranges(low, high - low)], np.repeat(suffix, high - low)


def _longest(at: np.ndarray, suffix: np.ndarray, items: Items, doc: np.ndarray) -> dict[int, list[dict]]:
    """For each document, its items with the longest verbatim match and where it starts; texts of one id are one item."""
    start = items.start[suffix]
    order = np.lexsort((at, at - start, items.item[suffix], doc))
    at, suffix, start, doc = at[order], suffix[order], start[order], doc[order]
    item, need = items.item[suffix], items.need[suffix]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(at))) - 1 + need[first]
    best: dict[int, dict[str | None, tuple[int, int]]] = {}
    for d, i, n, a in zip(doc[first].tolist(), item[first].tolist(), words.tolist(), at[first].tolist(), strict=True):
        own, name = best.setdefault(d, {}), items.names[i]
        if name not in own or n > own[name][0]:
            own[name] = (n, a)
    return {d: [{"item_id": i, "words": n, "at": a} for i, (n, a) in own.items()] for d, own in best.items()}


def _search_group(words: list[list[bytes]], items: Items, window: int) -> tuple[np.ndarray, dict[int, list[dict]]]:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    codes = np.concatenate([_codes.of(w) for w in words]) if words else np.zeros(0, np.uint64)
    total = len(codes)
    change = np.zeros(total + 1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if total and len(items.vocabulary):
        at = np.minimum(np.searchsorted(items.vocabulary, codes), len(items.vocabulary) - 1)
        ranks = np.where(items.vocabulary[at] == codes, at + 1, 0).astype(np.int64)
        for low in range(0, total, SHARD_WORDS):
            where, suffix = SuffixArray(ranks[low : low + SHARD_WORDS + window - 1], window).search(items)
            where = where + low
            last = where + items.need[suffix] - 1
            inside = (last < total) & (np.searchsorted(ends, where, "right") == np.searchsorted(ends, last, "right"))
            found.append((where[inside], suffix[inside]))
    where, suffix = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    np.add.at(change, where, 1)
    np.add.at(change, where + items.need[suffix], -1)
    return np.cumsum(change[:-1]) > 0, _longest(where, suffix, items, np.searchsorted(ends, where, "right"))


def _searcher(held, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        match = pa.list_(pa.struct([("item_id", pa.string()), ("words", pa.int32()), ("at", pa.int64())]))

        def flush(rows: list, docs: list, words: list) -> pa.RecordBatch:
            hit, matches = _search_group(words, items, window)
            low, spans, counts = 0, [], []
            own = []
            for d, w in enumerate(words):
                out = hit[low : low + len(w)]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0])))) if out.any() else np.zeros(0, np.int64)
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                own.append([{**m, "at": m["at"] - low} for m in matches.get(d, [])])
                counts.append(len(w))
                low += len(w)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(own, match)],
                names=["row", "doc_id", "n_words", "spans", "matches"],
            )

        rows, docs, words, size = [], [], [], 0
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append(row)
                docs.append(doc)
                words.append(words_of(text))
                size += len(words[-1])
                if size >= SHARD_WORDS:
                    yield flush(rows, docs, words)
                    rows, docs, words, size = [], [], [], 0
        if rows:
            yield flush(rows, docs, words)

    return run


def search_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = 32 << 20) -> DataFrame:
    """A row for each document: n_words, spans of words inside occurring windows, and the longest match with each item."""
    spark = docs.sparkSession
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-int(size) // slice_bytes))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if slices > 1:
        read = written(read, "numbered-documents")  # every slice must see the same numbers
    parts = []
    for i in range(slices):
        of_slice = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)
        items = Items.of(sorted(((r.item_id, r.text) for r in of_slice.collect()), key=lambda x: (x[0] or "", x[1] or "")), window)
        parts.append(read.mapInArrow(_searcher(spark.sparkContext.broadcast(items), window), FOUND))
    if slices == 1:
        return parts[0].drop("row")
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    merged = together.groupBy("row", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("matches")).alias("matches")
    )
    return merged.withColumns({"spans": _merged_spans(F.col("spans")), "matches": _by_item(F.col("matches"))}).drop("row")


def _by_item(matches):
    """The longest match of each item, whose texts may have stood in several slices; the first of equals."""

    def longest(item):
        own = F.filter(matches, lambda m: m["item_id"].eqNullSafe(item))
        return F.array_min(F.transform(own, lambda m: F.struct((-m["words"]).alias("less"), m["at"].alias("at"))))

    ids = F.array_distinct(F.transform(matches, lambda m: m["item_id"]))
    found = F.transform(ids, lambda i: F.struct(i.alias("item_id"), longest(i).alias("m")))
    return F.transform(found, lambda x: F.struct(x["item_id"], (-x["m"]["less"]).alias("words"), x["m"]["at"].alias("at")))


def _merged_spans(spans):
    """Overlapping or touching spans made one."""
    start = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))),
        )
        apart = F.concat(done, F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"))))
        return F.when(F.size(done) == 0, apart).when(span["start"] <= F.try_element_at(done, F.lit(-1))["end"], grown).otherwise(apart)

    return F.aggregate(F.array_sort(spans), start, add)


def with_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    items = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark stands, with their own columns."""
    rows = keyed(docs).withColumn("row_hash", F.xxhash64("id", "text_hash"))
    numbered = rows.select(F.col("row_hash").alias("doc_id"), "document.text")
    bad = search_benchmark(numbered, benchmark, window).where(F.size("spans") > 0).select(F.col("doc_id").alias("bad")).distinct()
    return rows.join(small(written(bad, "contaminated")), F.col("row_hash") == F.col("bad"), "left_anti").select("document.*")


__all__ = ["remove_contaminated", "search_benchmark", "with_digest"]
