"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder as a state machine.

Whether two bytes stay apart can depend on bytes to the right, but only so far: a merge waits for its right part, and that
part can only be taken away by merges of higher priority that start in its right edge. ``Merges.lookahead`` adds this up
over the merge list. A transducer keeps that many bytes; tokens that end before them are final and are emitted at once.
So memory does not grow with the text, however long it goes on without a break. What follows an emitted token is encoded as if it stood alone.

Short pieces between breaks, which repeat a lot, are remembered within a bound.

Defined results: a null text is empty and has no tokens. Special tokens in a text become their ids, as the tokenizer's file
says. Repeated rows each get a row; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import sha256_hex

# The white space of Unicode, and the byte-level pre-tokenizer's pattern over it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
UNEVEN = re.compile(rf" [{SPACE}]|[{SPACE}] |\A[{SPACE}]|[{SPACE}]\Z")
SHORT = 64
NO_PAIR, ID_PART = 1 << 62, (1 << 32) - 1


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own bytes; the other bytes follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A tokenizer's file as tables over ids."""

    def __init__(self, file: str) -> None:
        data = json.loads(file)
        model, alphabet = data["model"], byte_alphabet()
        if model["type"] != "BPE" or data.get("normalizer") or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("Not a byte-level BPE without a normalizer")
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        parts: list[tuple[int, int]] = []
        for pair in model["merges"]:
            left, right = (raw(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault((ids[left], ids[right]), (len(parts), ids[left + right]))
            parts.append((ids[left], ids[right]))
        self.special: dict[str, int] = {}
        for token in data.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("Added tokens that take neighbours are not supported")
            self.special[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        self.lookahead = self._lookahead(parts)
        self.numbers = {pair: order << 32 | made for pair, (order, made) in self.rank.items()}

    def _lookahead(self, parts: list[tuple[int, int]]) -> int:
        """How many bytes to the right can decide whether a token ends here."""
        right_part: dict[int, int] = {}
        reach: dict[int, int] = {}  # by left part: the farthest any merge so far has to see
        most = 0
        for left, right in parts:
            edge, beyond = right, 0
            while True:
                beyond = max(beyond, reach.get(edge, 0))
                if edge not in right_part:
                    break
                edge = right_part[edge]
            sees = len(self.bytes_of[right]) + beyond
            reach[left] = max(reach.get(left, 0), sees)
            most = max(most, sees)
            right_part.setdefault(self.rank[left, right][1], right)
        return most + max(map(len, self.bytes_of.values()))

    def merge(self, data: bytes) -> list[int]:
        ids = [self.single[b] for b in data]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The leftmost pair of the best rank, again and again; a pair's number has its rank above its id."""
        find = self.numbers.get
        numbers = [find(p, NO_PAIR) for p in zip(ids, ids[1:])]
        while numbers and (best := min(numbers)) != NO_PAIR:
            i = numbers.index(best)
            ids[i : i + 2] = (best & ID_PART,)
            del numbers[i]
            if i:
                numbers[i - 1] = find((ids[i - 1], ids[i]), NO_PAIR)
            if i < len(numbers):
                numbers[i] = find((ids[i], ids[i + 1]), NO_PAIR)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        ids, after, before = list(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            order, made, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.rank.get((ids[i], ids[j])) != (order, made):
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (found := self.rank.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (*found, a))
        return [i for i in ids if i >= 0]


class Transducer:
    """Bytes of one piece in, final token ids out."""

    def __init__(self, merges: Merges, step: int = 4096) -> None:
        self.merges, self.step, self.held = merges, step, b""

    def feed(self, data: bytes) -> Iterator[int]:
        for low in range(0, len(data), self.step):
            self.held += data[low : low + self.step]
            if len(self.held) < self.merges.lookahead + self.step:
                continue
            final, used = len(self.held) - self.merges.lookahead, 0
            for token in self.merges.merge(self.held):
                size = len(self.merges.bytes_of[token])
                if used + size > final:
                    break
                used += size
                yield token
            self.held = self.held[used:]

    def finish(self) -> Iterator[int]:
        yield from self.merges.merge(self.held)
        self.held = b""


class Remembered(dict):
    """What ``make`` gave for short keys: the last ``limit`` or more of them, in two generations."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= SHORT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, merges: Merges, limit: int = 150_000) -> None:
        self.merges = merges
        self.packed = {i: i.to_bytes(4, "little") for i in merges.bytes_of}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.pieces = Remembered(self._piece, limit)
        self.parts = Remembered(self._part, limit)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= SHORT:
            tokens = self.merges.merge(data)
        else:
            stream = Transducer(self.merges)
            tokens = chain(stream.feed(data), stream.finish())
        return b"".join(map(self.packed.__getitem__, tokens))

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            return self._piece(" " + part)
        return self._plain(" " + part)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if UNEVEN.search(text):
            return self._plain(text)
        # single spaces only: a space begins a piece, so the parts can be encoded one by one
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self.parts.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out.append(np.array([self.merges.special[part]], "<u4").tobytes() if i % 2 else self._ordinary(part))
        return b"".join(out)


class Decoder:
    """Ids to text, a chunk at a time; bytes of an unfinished character wait for the next chunk."""

    def __init__(self, merges: Merges, chunk: int = 1 << 16) -> None:
        self.table = [merges.bytes_of.get(i, b"") for i in range(max(merges.bytes_of) + 1)]
        self.chunk = chunk

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.asarray(ids)
        for low in range(0, len(ids), self.chunk):
            yield state.decode(b"".join(map(self.table.__getitem__, ids[low : low + self.chunk].tolist())))
        yield state.decode(b"", True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.stream(np.frombuffer(ids, "<u4")))


_tools: dict[int, tuple[Encoder, Decoder]] = {}


def tools(file: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for each tokenizer in a worker."""
    key = hash(file)
    if key not in _tools:
        _tools.clear()
        merges = Merges(file)
        _tools[key] = (Encoder(merges), Decoder(merges))
    return _tools[key]


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded text, and the digests of both."""
    with open(path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # the tokenizer's file, read where the driver has it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = tools(held.value)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                texts = [decoder.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string()),
                     pa.array([sha256_hex(i) for i in ids]), pa.array([sha256_hex(t.encode("utf-8", "surrogatepass")) for t in texts])],
                    names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string")
