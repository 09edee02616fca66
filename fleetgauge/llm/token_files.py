"""Token ids of a corpus as files of range-coded blocks (see ``range_coder``), and their reader.

Writing: documents are dealt by ranges of doc_id and sorted, and encoded once; one frequency table is counted over
all ids, and blocks are coded with it independently. Reading: every block is decoded and checked
by itself, in parallel; what a block holds of a document is put together by document.

A folder holds ``blocks`` (Parquet, a frame in each row, so that files appear whole or not at all when tasks are
repeated) and ``table`` (the counts of the ids). Nothing that grows with the corpus goes through
the driver but one number for each range.

Defined results: a null text is empty, and its document has the end id alone. Documents come in ascending doc_id, null
first; rows with one doc_id in the order of their texts' hashes. Repeated rows are all written. An empty table gives
an empty folder. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import range_coder as coder
from fleetgauge.llm.byte_pairs import Remembered, byte_alphabet
from fleetgauge.llm.common import written
from fleetgauge.session import scratch

GROUP = 24  # blocks that are coded side by side
CHUNK = 8 << 20  # bytes of text whose words are looked up together
_tokenizers: dict[int, WordEncoder] = {}


# The word tokenizer's pattern, and printable characters that its normalizer only puts in lower case.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]+")
SIGNS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
# Letters, then signs: a piece of each. No pattern of contractions fits, as these have letters after a sign.
SIMPLE = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*[!-/:-@\\[-`{-~]*$"


class WordEncoder:
    """A tokenizer that drops white space, applied to what stands between spaces: once to each different word of a chunk.

    Simple words are cut into pieces by Arrow, other plain ones here, and only the pieces go to the tokenizer's model,
    which are remembered; any others go through all of it.
    """

    def __init__(self, file: str, limit: int = 450_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        data = json.loads(file)
        steps = [x["type"] for x in [*data["normalizer"]["normalizers"], *data["pre_tokenizer"]["pretokenizers"]]]
        if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("Not a word tokenizer that drops white space")
        self.special = [t["content"] for t in data["added_tokens"]]
        if any(re.match(SIMPLE, s) for s in self.special):
            raise ValueError("A special token looks like a simple word")
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.packed = [i.to_bytes(int(self.kind[-1]), "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = Remembered(self._piece, 600_000)
        self.words = Remembered(self._word, limit)

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(text)]) if text else b""

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))
        return b"".join([self.packed[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _simple(self, words: pa.Array) -> pa.Array:
        """The ids of words that are letters and then signs, both being one piece."""
        starts = _offsets(words)
        cuts = np.empty(2 * len(words) + 1, np.int32)
        cuts[::2], cuts[1::2] = starts, starts[:-1] + pc.binary_length(pc.ascii_rtrim(words, SIGNS)).to_numpy()
        pieces = pc.utf8_lower(_array(pa.string(), cuts, words)).dictionary_encode()
        ids = _made(self.pieces, pieces.dictionary).take(pieces.indices)
        return _array(pa.binary(), _offsets(ids)[::2].copy(), ids)

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, pa.Buffer]:
        """The ids of all texts, each followed by ``end``, and before them at which byte each text's begin and the last one's stop."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        stops = np.diff(split.offsets.to_numpy()).cumsum()
        words = split.flatten().dictionary_encode()
        simple = pc.match_substring_regex(words.dictionary, SIMPLE)
        fits = simple.to_numpy(zero_copy_only=False)
        ids = [self._simple(words.dictionary.filter(simple)), _made(self.words, words.dictionary.filter(pc.invert(simple))), pa.array([end], pa.binary())]
        place = np.where(fits, np.cumsum(fits) - 1, fits.sum() + np.cumsum(~fits) - 1)
        order = np.insert(place[words.indices.to_numpy()], stops, len(place))
        found = pa.concat_arrays(ids).cast(pa.large_binary()).take(pa.array(order))
        return _offsets(found)[np.append(0, stops + np.arange(1, len(stops) + 1))], found.buffers()[2]

    def encode(self, text: str | None) -> bytes:
        cuts, ids = self.encode_all(pa.array([text], pa.string()))
        return ids.to_pybytes()[: cuts[-1]] if ids else b""


def _made(known: Remembered, keys: pa.Array) -> pa.Array:
    return pa.array(list(map(known.__getitem__, keys.to_numpy(zero_copy_only=False))), pa.binary())


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.dtype(np.int64 if pa.types.is_large_binary(array.type) else np.int32)
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * kind.itemsize) if len(array) else np.zeros(1, kind)


def _array(kind: pa.DataType, offsets: np.ndarray, of: pa.Array) -> pa.Array:
    """An array of the bytes of another, cut at other offsets."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets), of.buffers()[2]])


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of text, or one row with more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64) + 8)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def word_encoder(file: str) -> WordEncoder:
    key = hash(file)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordEncoder(file)
    return _tokenizers[key]


def _encoded(docs: DataFrame, file: str, end: int) -> DataFrame:
    """Rows (part, at, doc_id, wide, ids): ``at`` ids stand before in the part."""
    held = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, at = word_encoder(held.value), TaskContext.get().partitionId(), 0
        last = np.array([end], encoder.kind).tobytes()
        width = len(last)
        for whole in batches:
            for batch in _chunks(whole, CHUNK):
                cuts, ids = encoder.encode_all(batch.column("text"), last)
                sizes = np.diff(cuts) // width
                places = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                n = batch.num_rows
                coded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts), ids]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(places), batch.column(0), pa.array([width] * n, pa.int32()),
                     pa.array(sizes), coded],
                    names=["part", "at", "doc_id", "width", "n", "ids"],
                )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "part int, at long, doc_id long, width int, n long, ids binary")


def _as_ids(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4")


def _counts(encoded: DataFrame) -> DataFrame:
    """(id, n): one row for each id and task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                width, data = part.column("width")[0].as_py(), b"".join(part.column("ids").to_pylist())  # one width in all rows
                own = np.bincount(_as_ids(width, data), minlength=len(total))
                own[: len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return encoded.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _frames(encoded: DataFrame, table: coder.Frequencies, before: dict[int, int]) -> DataFrame:
    held = encoded.sparkSession.sparkContext.broadcast((table, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = held.value
        frames, blocks = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if blocks:
                coded = coder.encode_blocks(blocks, table)
                body = [coder.to_bytes(f, len(b), c, table) for f, b, c in zip(frames, blocks, coded, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f.start for f in frames], pa.int64()), pa.array(body, pa.binary())], names=["start", "frame"])
                frames.clear()
                blocks.clear()

        ids, docs, at, size, start = [], [], [], 0, 0
        carried, carried_doc, expected = 0, None, None

        def close() -> None:
            nonlocal ids, docs, at, size
            if size:
                known = np.array([d is not None for d in docs], bool)
                frames.append(coder.Frame(start, carried, carried_doc, np.array([d or 0 for d in docs], np.int64), ~known, np.array(at, np.int64)))
                blocks.append(np.concatenate(ids))
            ids, docs, at, size = [], [], [], 0

        for batch in batches:
            for part, place, doc, width, data in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "width", "ids")), strict=True):
                own, first = _as_ids(width, data), before[part] + place
                if first != expected:  # another part of the corpus
                    close()
                    start = first
                docs.append(doc)
                at.append(size)
                used = 0
                while used < len(own):
                    piece = own[used : used + coder.BLOCK - size]
                    ids.append(piece)
                    used, size = used + len(piece), size + len(piece)
                    if size == coder.BLOCK:
                        close()
                        start = first + used
                        carried, carried_doc = first, doc
                        if len(blocks) == GROUP:
                            yield from flush()
                expected = first + len(own)
        close()
        yield from flush()

    return encoded.select("part", "at", "doc_id", "width", "ids").mapInArrow(run, "start long, frame binary")


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 2) -> None:
    """Encode whole texts with the tokenizer's file at path ``tokenizer``, append ``end`` to each, and write the folder."""
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    encoded = written(_encoded(docs, file, end), "token-ids", "snappy")
    counts = written(_counts(encoded), "id-counts")
    found = [(r.id, r.n) for r in counts.collect()]  # bounded by the vocabulary
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one number a range
    counts.coalesce(1).write.parquet(f"{folder}/table")
    before, running = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        before[r.part] = running
        running += r.n
    _frames(encoded, _table(found), before).write.option("compression", "none").parquet(f"{folder}/blocks")


def _table(found: list[tuple[int, int]]) -> coder.Frequencies:
    counts = np.zeros(max((i for i, _ in found), default=0) + 1, np.int64)
    for i, n in found:
        counts[i] = n
    return coder.Frequencies.of(counts)


def _decoder(spark: SparkSession, folder: str):
    held = spark.sparkContext.broadcast(_table([(r.id, r.n) for r in spark.read.schema("id long, n long").parquet(f"{folder}/table").collect()]))

    def decode(frames: list[bytes]) -> Iterator[tuple[coder.Frame, np.ndarray]]:
        for low in range(0, len(frames), GROUP):
            read = [coder.from_bytes(f, held.value.bits) for f in frames[low : low + GROUP]]
            yield from zip((f for f, _ in read), coder.decode_blocks([p for _, p in read], held.value), strict=True)

    return decode


FRAGMENT = "start long, doc_id long, at long, n long, crc long"


def _fragments(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    """What each block has of each document: where the document starts, where the fragment does, its length and crc32."""
    decode = _decoder(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, ids in decode(batch.column("frame").to_pylist()):
                data = ids.astype("<u4").tobytes()
                starts = frame.at.tolist()
                docs = [None if null else d for d, null in zip(frame.docs.tolist(), frame.nulls.tolist(), strict=True)]
                stops = [*starts[1:], len(ids)] if starts else []
                rows = list(zip((frame.start + s for s in starts), docs, starts, stops, strict=True))
                if not starts or starts[0]:
                    rows.insert(0, (frame.carried, frame.carried_doc, 0, starts[0] if starts else len(ids)))
                columns = [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([frame.start + r[2] for r in rows], pa.int64()), pa.array([r[3] - r[2] for r in rows], pa.int64()),
                    pa.array([zlib.crc32(data[4 * r[2] : 4 * r[3]]) for r in rows], pa.int64()),
                ]
                names = ["start", "doc_id", "at", "n", "crc"]
                if with_ids:
                    columns.append(pa.array([data[4 * r[2] : 4 * r[3]] for r in rows], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    frames = spark.read.schema("start long, frame binary").parquet(f"{folder}/blocks").select("frame")
    return frames.mapInArrow(run, FRAGMENT + (", ids binary" if with_ids else ""))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(start, doc_id, at, ids): the ids of the corpus by fragments of documents, to be read in order of ``at``."""
    return _fragments(spark, folder, True).select("start", "doc_id", "at", "ids")


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: coder.joined_crc([(x["crc"], 4 * x["n"]) for x in p]))

    gathered = _fragments(spark, folder, False).groupBy("start").agg(
        F.min("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts")
    )
    return gathered.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))


def write_and_read(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_tokens(docs, tokenizer, folder, end)
    return token_digest(spark, folder)
