"""Digests of ranges of files, and of whole files of any size.

``spark.read.format("file_ranges")`` is a data source with a row (path, offset, length, sha256) for each range of each file
below a folder. A partition is a list of spans of files: a large file is read by many tasks, small files share one, and
a task holds one chunk at a time, whatever the range. The driver lists names and sizes only.

Files are opened through ``pyarrow.fs``, which must know the folder's scheme; executors need this package, as for any
Python data source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
PARTITION_BYTES = 256 << 20  # bytes a task reads
CHUNK_BYTES = 1 << 20  # bytes a task holds
WHOLE_BYTES = 128 << 20  # files up to this size are hashed as one value in the JVM, larger ones are streamed


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def digest_of(stream, length: int) -> tuple[int, str]:
    """Bytes read (fewer than asked at the end of a file) and their SHA-256, a chunk at a time."""
    digest, left = hashlib.sha256(), length
    while left > 0:
        chunk = stream.read(min(CHUNK_BYTES, left))
        if not chunk:
            break
        digest.update(chunk)
        left -= len(chunk)
    return length - left, digest.hexdigest()


@dataclass
class Spans(InputPartition):
    """(path below the folder, first byte, byte after the last); all but a file's last span end where a range ends."""

    spans: list[tuple[str, int, int]]


def pack(files: list[tuple[str, int]], range_bytes: int, partition_bytes: int) -> list[Spans]:
    """Files cut into spans and dealt in order to partitions of at most ``partition_bytes``, or of one range if that is more."""
    step = max(1, partition_bytes // range_bytes) * range_bytes
    packed, spans, room = [], [], step
    for path, size in files:
        start = 0
        while start < size or (size == 0 and start == 0):
            stop = min(size, start + step)
            if spans and stop - start > room:
                packed, spans, room = [*packed, Spans(spans)], [], step
            spans.append((path, start, stop))
            # An empty file takes a byte of room, so that empty files alone do not grow a partition without end.
            room -= max(1, stop - start)
            start = max(stop, start + 1)
    return [*packed, Spans(spans)] if spans else packed


class RangeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"].rstrip("/")
        self.suffix = options.get("suffix", "")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        if self.range_bytes < 1:
            raise ValueError("rangeBytes must be positive")

    def partitions(self) -> list[Spans]:
        system, root = filesystem(self.folder)
        files = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            below = info.path[len(root):].lstrip("/")
            hidden = any(part.startswith((".", "_")) for part in below.split("/"))
            if info.type == fs.FileType.File and not hidden and below.endswith(self.suffix):
                files.append((below, info.size))
        return pack(sorted(files), self.range_bytes, self.partition_bytes) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[tuple[str, int, int, str]]:
        system, root = filesystem(self.folder)
        for path, start, stop in partition.spans:
            with system.open_input_file(f"{root}/{path}") as stream:
                stream.seek(start)
                for offset in range(start, max(stop, start + 1), self.range_bytes):
                    length, sha256 = digest_of(stream, min(self.range_bytes, stop - offset))
                    yield path, offset, length, sha256


class FileRanges(DataSource):
    """Options: ``path`` (a folder), ``rangeBytes``, ``partitionBytes``, ``suffix`` of the files' names."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, offset long, length long, sha256 string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def range_digests(
    spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, partition_bytes: int = PARTITION_BYTES, suffix: str = ""
) -> DataFrame:
    """(path below the folder, offset, length, sha256) of every range; an empty file has one of no bytes, hidden files none."""
    spark.dataSource.register(FileRanges)
    options = {"rangeBytes": range_bytes, "partitionBytes": partition_bytes, "suffix": suffix}
    return spark.read.format("file_ranges").options(**options).load(folder)


def folded_digests(ranges: DataFrame) -> DataFrame:
    """(path, byte_size, ranges, folded_sha256): a file's digest over those of its ranges in order, 64 characters for each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "sha256")))
    return ranges.groupBy("path").agg(
        F.sum("length").alias("byte_size"), F.count(F.lit(1)).alias("ranges"),
        F.sha2(F.concat_ws("\n", F.transform(parts, lambda p: p["sha256"])), 256).alias("folded_sha256"),
    )


def differing_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, offset, state) of ranges that are missing, extra or changed; both sides cut at the same offsets."""
    old = before.select("path", "offset", F.struct("length", "sha256").alias("old"))
    new = after.select("path", "offset", F.struct("length", "sha256").alias("new"))
    state = (
        F.when(F.col("new").isNull(), F.lit("missing")).when(F.col("old").isNull(), F.lit("extra"))
        .when(F.col("old") != F.col("new"), F.lit("changed"))
    )
    compared = old.join(new, ["path", "offset"], "full_outer").select("path", "offset", state.alias("state"))
    return compared.filter(F.col("state").isNotNull())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
            system, name = filesystem(path)
            with system.open_input_stream(name) as stream:
                read, sha256 = digest_of(stream, length)
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [read], "sha256": [sha256]})


def file_digests(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, length, sha256) of every file of any size but 0: Spark's listing leaves out empty files.

    Spark lists the files. Those of at most ``whole_bytes`` are values in the JVM; the filter on length reaches the
    listing, so larger ones are never loaded, but streamed by a task each.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder)
    small = files.filter(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_bytes).select("path", "length")
    return small.unionByName(large.mapInArrow(_streamed, "path string, length long, sha256 string"))
