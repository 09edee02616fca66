"""Similarity join of documents by the Jaccard similarity of their word shingles: rare-first prefix filtering.

1. Documents with one sequence of words are a class; one of them stands for it. Hashes of its distinct shingles
   go to buckets once a block, which count in how many classes each occurs and answer the block.
2. A set is ordered rarest first. Two sets that are similar enough share one of the first n - ⌈0.8 n⌉ + 1 shingles of
   each, so only these are joined, and of these only the ones that another class has.
3. Per shingle, the class with the least number leads; others are compared with it if the lengths allow (length filter).
   Links make components. Shingles whose classes are now all in one component are done.
4. What is left is cut into groups that share shingles, and these into cells of bounded size. A cell holds
   whole sets: it compares pairs of different components, bounded by what may still follow their last
   common prefix shingle (positional filter) and by how the rest of both splits around a middle shingle
   (suffix filter), and counts each pair that passes once. It returns a spanning forest of its links.

So no pair inside a component is ever listed: a group of copies costs as many comparisons as it has members.

Defined results: a null text or one without words has an empty set, and links with nothing. Fewer words than a shingle are one
shingle. Rows with one doc_id are documents of their own. A component of rows without doc_id has no id.
An empty table gives an empty result. Only doc_id and text are read; ``keep_first`` keeps the other columns.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import BLOCK_CHARS, IN_PART, WordCodes, as_bytes, keyed, mixed, small, store_blocks, written

WORDS, PERCENT = 5, 80
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_codes = WordCodes()
_LOW40 = np.uint64((1 << 40) - 1)
SENT = "bucket int, block long, body binary"


@dataclass(frozen=True)
class CellLimits:
    """A chunk of a cell has about so many documents, and so many shingles, at most."""

    docs: int = 1_000
    shingles: int = 400_000


def words_of(text: str | None) -> list[bytes]:
    return as_bytes(text).translate(_LOWER).split()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    codes = _codes.of(words)
    n = len(codes) - WORDS + 1
    x = codes[:n]
    for i in range(1, WORDS):
        x = mixed(x + codes[i : n + i])
    return np.unique(mixed(x))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def similar(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def _hashes_of(texts: list[str | None]) -> pa.Array:
    """What Spark's xxhash64 gives for the texts."""
    return pa.array(np.array([xxhash.xxh64_intdigest(as_bytes(t), seed=42) for t in texts], np.uint64).view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids, texts in zip(*(batch.column(c) for c in ("block", "ids", "texts")), strict=True):
            words, plain = [words_of(t) for t in texts.as_py()], texts.as_py()
            first = block.as_py() << IN_PART
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(words)) + first, pa.int64()), pa.array(ids.as_py(), pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words], pa.binary()), _hashes_of(plain)],
                names=["node", "doc_id", "n_words", "digest", "text_hash"],
            )


def _bucketed(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high bits, 40 bits of the hash in the low ones."""
    return (((values >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40)) | (values & _LOW40)


def _sender(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block, texts, chosen in zip(*(batch.column(c) for c in ("block", "texts", "chosen")), strict=True):
                sets = [shingles(texts[i].as_py()) for i in chosen.as_py()]
                keys, counts = np.unique(_bucketed(np.concatenate(sets), buckets), return_counts=True)
                edges = np.searchsorted(keys >> np.uint64(40), np.arange(buckets + 1, dtype=np.uint64))
                five = (keys & _LOW40).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows = [
                    (b, five[x:y].tobytes() + press.compress(counts[x:y].astype("<u4").tobytes()), y - x)
                    for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if x < y
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([block.as_py()] * len(rows), pa.int64()),
                     pa.array([r[2].to_bytes(4, "little") + r[1] for r in rows], pa.binary())],
                    names=["bucket", "block", "body"],
                )

    return run


def _count(rows: pa.Table) -> pa.Table:
    values, counts, sizes = [], [], []
    for body in rows.column("body").to_pylist():
        n = int.from_bytes(body[:4], "little")
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(body, np.uint8, 5 * n, 4).reshape(-1, 5)
        values.append(wide.view("<u8").ravel())
        counts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(body[4 + 5 * n :]), "<u4"))
        sizes.append(n)
    _, inverse = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)[inverse]
    edges = np.concatenate(([0], np.cumsum(sizes)))
    press = zstandard.ZstdCompressor(level=1)
    answers = [press.compress(np.minimum(total[x:y], (1 << 32) - 1).astype("<u4").tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "body": pa.array(answers, pa.binary())})


def _prefixes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts, chosen, answers in zip(*(batch.column(c) for c in ("block", "texts", "chosen", "answers")), strict=True):
                places = chosen.as_py()
                sets = [shingles(texts[i].as_py()) for i in places]
                keys = [_bucketed(s, buckets) for s in sets]
                known = np.unique(np.concatenate(keys))
                parts = {a["bucket"]: a["body"] for a in answers.as_py()}
                often = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[b]), "<u4") for b in sorted(parts)])
                all_keys, ends = np.concatenate(keys), np.cumsum([len(k) for k in keys])
                counts = often[np.searchsorted(known, all_keys)]
                starts = ends - [len(k) for k in keys]
                alone = np.add.reduceat((counts == 1).astype(np.int64), starts)
                first = block.as_py() << IN_PART
                prefixes, wholes = [], []
                for own, low, high, single in zip(sets, starts.tolist(), ends.tolist(), alone.tolist(), strict=True):
                    length = prefix_length(len(own))
                    if single >= length:  # nothing in the prefix is shared
                        prefixes.append(own[:0])
                        wholes.append(own[:0])
                        continue
                    count = counts[low:high]
                    order = np.lexsort((own, count))
                    prefixes.append(own[order[single:length]].view(np.int64))
                    wholes.append(own[order].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + i for i in places], pa.int64()), pa.array([len(k) for k in keys], pa.int64()),
                     pa.array([p.view(np.int64) for p in prefixes], pa.list_(pa.int64())), pa.array([w.view(np.int64) for w in wholes], pa.list_(pa.int64()))],
                    names=["node", "n", "prefix", "shingles"],
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b): each takes the least root around it, then the root of its root, until none changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root"))
    roots, before = written(roots, "roots"), None
    while True:
        now = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return roots
        before = now
        around = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("other"))
        nearer = written(roots.join(around, F.col("node") == F.col("a")).select("node", F.least("root", "other").alias("root")), "roots")
        jump = nearer.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        roots = written(nearer.join(jump, F.col("root") == F.col("_node")).select("node", F.col("_root").alias("root")), "roots")


def _lengths_allow(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def led_links(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (a, b) of each class with the leaders of its prefix shingles."""
    leaders = tokens.groupBy("token").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    leaders = leaders.select("token", F.col("first.node").alias("a"), F.col("first.n").alias("a_n"))
    pairs = tokens.join(leaders, "token").where((F.col("node") != F.col("a")) & _lengths_allow("n", "a_n")).select("a", F.col("node").alias("b")).distinct()
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(right, "b").join(left, "a").withColumn("common", common)
    return joined.where(100 * F.col("common") >= PERCENT * (F.size("a_set") + F.size("b_set") - F.col("common"))).select("a", "b")


def _suffix_allows(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Both sorted: can they share ``need`` values? Split around the middle value of the longer one."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return need <= 0
    middle = a[len(a) // 2]
    x, y = len(a) // 2, int(np.searchsorted(b, middle))
    has = int(y < len(b) and b[y] == middle)
    return min(x, y) + has + min(len(a) - x - 1, len(b) - y - has) >= need


def links_of_cell(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, prefixes: list[np.ndarray], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components. With two sides, only pairs across them.

    ``sets`` are ordered rarest first, ``prefixes`` the part of each that another class has."""
    size = np.array([len(s) for s in sets])
    parent = {int(r): int(r) for r in roots}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    places = [{int(t): i for i, t in enumerate(s[: prefix_length(len(s))])} for s in sets]
    ordered = [np.sort(s) for s in sets]
    two = len(set(sides.tolist())) > 1
    postings: dict[int, list[int]] = {}
    found: list[tuple[int, int]] = []
    for y in np.argsort(size, kind="stable").tolist():  # shorter ones first
        seen: dict[int, list[int]] = {}
        for t in prefixes[y].tolist():
            for x in postings.get(t, ()):
                if not (two and sides[x] == sides[y]) and 100 * size[x] >= PERCENT * size[y]:
                    had = seen.setdefault(x, [0, 0, 0])
                    had[0] += 1
                    had[1], had[2] = places[x][t], max(had[2], places[y][t])
            postings.setdefault(t, []).append(y)
        for x, (shared, _, at) in seen.items():
            if root(int(roots[x])) == root(int(roots[y])):
                continue
            need = -(-PERCENT * int(size[x] + size[y]) // (100 + PERCENT))
            if shared + min(size[x] - shared, size[y] - at - 1) < need or not _suffix_allows(ordered[x], ordered[y], need):
                continue
            common = len(np.intersect1d(ordered[x], ordered[y], assume_unique=True))
            if similar(common, int(size[x]), int(size[y])):
                found.append((int(nodes[x]), int(nodes[y])))
                parent[root(int(roots[y]))] = root(int(roots[x]))
    return found


def cell_links(sets: DataFrame, tokens: DataFrame, roots: DataFrame, limits: CellLimits) -> DataFrame:
    """Links (a, b) between components that still share a prefix shingle, found in cells."""
    placed = tokens.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed-tokens")
    still = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first")).where("low < high")
    still = written(still.select("token", "first"), "open-shingles")
    open_ = written(placed.join(still, "token").select("node", "root", "n", "first").distinct(), "open-classes")
    groups = components(open_.select(F.col("first").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "group")
    members = written(open_.select("node", "root", "n").distinct().join(groups, "node"), "cell-members")
    # components that fill chunks of their own get some; the other members of a group share the rest
    weight = F.greatest(F.lit(1.0) / limits.docs, F.col("n") / F.lit(float(limits.shingles)))
    of_root = members.groupBy("group", "root").agg(F.sum(weight).alias("weight"))
    of_root = of_root.withColumn("owner", F.when(F.col("weight") >= 1, F.col("root")).otherwise(F.lit(-1)))
    of_owner = of_root.groupBy("group", "owner").agg(F.ceil(F.sum("weight")).cast("int").alias("chunks"))
    dealt = members.join(of_root.select("group", "root", "owner"), ["group", "root"]).join(of_owner, ["group", "owner"])
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    chunks = of_owner.select("group", "owner", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    left, right = (chunks.select("group", F.col("owner").alias(f"owner{i}"), F.col("chunk").alias(f"chunk{i}")) for i in (1, 2))
    cells = left.join(right, "group").where(
        (F.struct("owner1", "chunk1") <= F.struct("owner2", "chunk2")) & ((F.col("owner1") != F.col("owner2")) | (F.col("owner1") == -1))
    )
    # a group that one component fills has no pair of its own left, but its members may meet the rest
    cells = written(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    sides = cells.select("cell", "group", F.col("owner1").alias("owner"), F.col("chunk1").alias("chunk"), F.lit(1).alias("side")).union(
        cells.where((F.col("owner1") != F.col("owner2")) | (F.col("chunk1") != F.col("chunk2"))).select("cell", "group", "owner2", "chunk2", F.lit(2))
    )
    filled = sides.join(dealt, ["group", "owner", "chunk"]).select("cell", "side", "node", "root").join(sets, "node")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        links = links_of_cell(
            frame["node"].to_numpy(), frame["root"].to_numpy(), frame["side"].to_numpy(), [np.asarray(p) for p in frame["prefix"]], [np.asarray(s) for s in frame["shingles"]]
        )
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return filled.groupBy("cell").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, limits: CellLimits = CellLimits(), block_chars: int = BLOCK_CHARS) -> DataFrame:  # noqa: B008
    """A row for each document: node (its number), doc_id, text_hash, n_shingles, class_node, component_node, component_id."""
    blocks, stored = store_blocks(docs, block_chars)
    buckets = max(64, 2 * stored)
    described = written(blocks.mapInArrow(_describe, "node long, doc_id long, n_words long, digest binary, text_hash long"), "word-sequences")
    classes = described.where("n_words > 0").groupBy("digest").agg(F.min("node").alias("class_node"), F.min("doc_id").alias("class_doc"))
    classes = written(classes, "word-classes")
    mask = F.lit((1 << IN_PART) - 1)
    chosen = classes.select(F.shiftright("class_node", IN_PART).alias("block"), F.col("class_node").bitwiseAND(mask).cast("int").alias("at"))
    chosen = chosen.repartition(stored, "block").groupBy("block").agg(F.array_sort(F.collect_list("at")).alias("chosen"))
    chosen = written(chosen, "chosen-documents")
    picked = blocks.select("block", "texts").join(chosen.repartition(stored, "block").hint("shuffle_hash"), "block")
    counted = picked.mapInArrow(_sender(buckets), SENT).groupBy("bucket").applyInArrow(_count, "block long, bucket int, body binary")
    answers = counted.repartition(stored, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("answers"))
    asked = picked.join(answers.hint("shuffle_hash"), "block")
    every = written(asked.mapInArrow(_prefixes(buckets), "node long, n long, prefix array<long>, shingles array<long>"), "prefixes")
    sets = every.where(F.size("prefix") > 0)
    tokens = written(sets.select("node", "n", F.explode("prefix").alias("token")), "prefix-shingles")
    led = written(led_links(sets, tokens), "led-links")
    further = written(cell_links(sets, tokens, components(led), limits), "cell-links")
    roots = components(led.union(further))
    # class_node, component_node and the least doc_id of the component
    rooted = classes.join(roots.withColumnRenamed("node", "class_node"), "class_node", "left").withColumn("root", F.coalesce("root", "class_node"))
    least = rooted.groupBy("root").agg(F.min("class_doc").alias("component_id"))
    sizes = every.select(F.col("node").alias("class_node"), F.col("n").alias("n_shingles"))
    named = rooted.join(least, "root").join(sizes, "class_node").select(
        "digest", "class_node", F.col("root").alias("component_node"), "component_id", "n_shingles"
    )
    result = described.join(named, "digest", "left")
    return result.select(
        "node", "doc_id", "text_hash", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("class_node", "node").alias("class_node"), F.coalesce("component_node", "node").alias("component_node"),
        F.when(F.col("class_node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """Of each component the document with the least doc_id stays, with its own columns; documents without words all stay.

    Rows that agree in doc_id and text are one document, and one of them stays.
    """
    found = written(near_duplicates(docs, **options), "components")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node", "text_hash")
    first = found.groupBy("component_node").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("first_id"), F.col("f.text_hash").alias("first_hash"))
    first = written(first.distinct(), "first-documents")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    others = found.select("doc_id", "text_hash").distinct().join(first, same, "left_anti")
    others = written(others.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash")), "later-documents")
    kept = keyed(docs).join(small(others), F.col("id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash")), "left_anti")
    if found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "text_hash"])
    return kept.select("document.*")
