"""What several operators share: tables, blocks of documents and small array helpers."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from fleetgauge.session import scratch

BLOCK_CHARS = 4_000_000
IN_PART = 20  # bits for the blocks of a partition, and for the documents of a block
MIX = np.uint64(0x9E3779B97F4A7C15)


def findable(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, unless it is installed or shipped otherwise."""
    root = str(Path(__file__).resolve().parents[2])
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join([root, known]) if known else root


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str, codec: str = "zstd") -> DataFrame:
    """Write once to the shared folder and read back: no step is computed twice, and lost executors cost nothing."""
    path = scratch(df.sparkSession, purpose)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, size: int = 64 << 20) -> DataFrame:
    """For a join with texts: rows of few bytes in all are sent to all tasks, so that the texts stay where they are;
    of more Spark chooses the join. ``df`` has been written, so measuring it is cheap."""
    measured = df.agg(F.sum(sum((_bytes_of(df, f.name, f.dataType) for f in df.schema), F.lit(32).cast("long")))).head()[0] or 0
    return F.broadcast(df) if measured <= size else df


def _bytes_of(df: DataFrame, name: str, kind: DataType) -> Column:
    """About the bytes that a value takes in a row."""
    value = df[name]
    if isinstance(kind, ArrayType):
        inner = len(kind.elementType.fields) + 2 if isinstance(kind.elementType, StructType) else 1
        return F.coalesce(F.size(value), F.lit(0)).cast("long") * (8 * inner) + 16
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    return F.lit(8).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as (document, id, text_hash). The own columns of a document, whatever their names,
    are the fields of one struct and cannot clash with those of an operator."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"))


def with_text(docs: DataFrame, text: Column) -> Column:
    """The document of a ``keyed`` row with another text, and with its length where ``docs`` has one."""
    changed = F.col("document").withField("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return changed


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that takes one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


# --- blocks ---------------------------------------------------------------------


def pack_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Consecutive rows of (doc_id, text) as rows of (block, ids, texts) of about ``block_chars`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << IN_PART) + made], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([texts], pa.list_(pa.string())),
                ],
                names=["block", "ids", "texts"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += 64 + len(text or "")
                if size >= block_chars:
                    yield flush()
                    made, ids, texts, size = made + 1, [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "block long, ids array<long>, texts array<string>"
    )


def store_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """The blocks as a table bucketed by block, and the number of its buckets.

    Joins by block then move only the other side: texts are written once and never shuffled.
    A block is a file or so, and a bucket holds a few of them.
    """
    spark = docs.sparkSession
    packed = pack_blocks(docs, block_chars)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"blocks_{uuid.uuid4().hex}"
    (
        packed.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, "blocks"))
        .bucketBy(buckets, "block").saveAsTable(name)
    )
    return spark.table(name), buckets


# --- arrays ---------------------------------------------------------------------


class WordCodes(dict):
    """64-bit codes of words, remembered within a bound."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in about log2(width) passes."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < width:
        x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
    return x


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, … counts[i] times, for every i."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    used = counts > 0
    s, c = starts[used].astype(np.int64), counts[used].astype(np.int64)
    heads = np.concatenate(([0], np.cumsum(c)[:-1]))
    step[heads] = s
    step[heads[1:]] -= s[:-1] + c[:-1] - 1
    return np.cumsum(step)
