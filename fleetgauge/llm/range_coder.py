"""Token ids in a static range asymmetric numeral system: one frequency table, independent interleaved blocks.

A block holds up to ``BLOCK`` ids. ``LANES`` coder states take turns over them and share one stream of 32-bit words. Every
``CHECK`` turns the states and the place in the stream are written down, so that a block can be
decoded from any of its checkpoints, and all of them at the same time. A frame is a block with its header, the
documents that start in it, its checkpoints and a checksum; frames may stand in any order or file.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC, VERSION = b"TKBL", 1
BLOCK, LANES, CHECK = 1 << 16, 64, 256
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sHHIIQQqBIIII")


@dataclass(frozen=True)
class Frequencies:
    """How often each id occurs, scaled to a power of two. Every id that occurs has one slot at least."""

    bits: int
    freq: np.ndarray
    below: np.ndarray
    symbol: np.ndarray  # of each slot

    @classmethod
    def of(cls, counts: np.ndarray) -> Frequencies:
        used = np.flatnonzero(counts)
        bits = max(16, int(len(used) * 4).bit_length())
        if bits > 30:
            raise ValueError("Too many different ids for one table")
        slots, total = 1 << bits, max(1, int(counts.sum()))
        freq = np.zeros(len(counts), np.int64)
        freq[used] = np.maximum(1, (counts[used].astype(np.float64) * slots / total).astype(np.int64))
        spare = slots - int(freq.sum())
        order = used[np.argsort(-freq[used], kind="stable")]
        if spare > 0 and len(order):
            freq[order[0]] += spare
        while spare < 0:  # taken from the most frequent, in proportion
            for i in order:
                take = min(-spare, int(freq[i]) // 2)
                freq[i] -= take
                spare += take
                if not spare:
                    break
        below = np.cumsum(freq) - freq
        return cls(bits, freq.astype(np.uint64), below.astype(np.uint64), np.repeat(np.arange(len(counts), dtype=np.uint32), freq))


@dataclass(frozen=True)
class Frame:
    start: int  # ids before this block
    carried: int  # where the document that comes in from the block before starts, and its id
    carried_doc: int | None
    docs: np.ndarray  # ids of the documents that start here
    nulls: np.ndarray
    at: np.ndarray  # and where


def encode_blocks(blocks: list[np.ndarray], table: Frequencies) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, checkpoint states, checkpoint places) of each block. Blocks of one number of turns go through the coder side by side."""
    out: list = [None] * len(blocks)
    by_turns: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        by_turns.setdefault(-(-len(b) // LANES), []).append(i)
    shift, most = np.uint64(table.bits), int(table.symbol[len(table.symbol) // 2])
    for turns, members in by_turns.items():
        ids = np.full((len(members), turns * LANES), most, np.int64)
        for row, i in zip(ids, members, strict=True):
            row[: len(blocks[i])] = blocks[i]
        ids = ids.reshape(len(members), turns, LANES)
        state = np.full((len(members), LANES), LOW, np.uint64)
        words, sent = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
        states = np.zeros((len(members), -(-turns // CHECK), LANES), np.uint64)
        for t in range(turns - 1, -1, -1):
            freq, below = table.freq[ids[:, t]], table.below[ids[:, t]]
            full = state >= freq << (np.uint64(63) - shift)
            words[:, t], sent[:, t] = state & np.uint64(0xFFFFFFFF), full
            state = np.where(full, state >> np.uint64(32), state)
            whole = state // freq
            state = (whole << shift) + (state - whole * freq) + below
            if t % CHECK == 0:
                states[:, t // CHECK] = state
        for m, i in enumerate(members):
            each = sent[m].sum(axis=1)
            places = (np.cumsum(each) - each)[::CHECK].astype(np.uint32)
            out[i] = (words[m][sent[m]], states[m], places)
    return out


def decode_blocks(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], table: Frequencies) -> list[np.ndarray]:
    """Ids of each (number of ids, words, states, places); all checkpoints of all blocks are decoded side by side."""
    shift, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    turns = [-(-n // LANES) for n, *_ in parts]
    segments = [(p, c, min(CHECK, turns[p] - c * CHECK)) for p in range(len(parts)) for c in range(len(parts[p][3]))]
    out = [np.zeros(t * LANES, np.uint32) for t in turns]
    for long in (True, False):  # segments of full length, then the last ones, in order of length
        group = sorted((s for s in segments if (s[2] == CHECK) == long), key=lambda s: -s[2])
        if not group:
            continue
        offset, bases = 0, {}
        for p in {s[0] for s in group}:
            bases[p] = offset
            offset += len(parts[p][1])
        stream = np.concatenate([*(parts[p][1] for p in bases), np.zeros(1, np.uint32)]).astype(np.uint64)
        state = np.stack([parts[p][2][c] for p, c, _ in group])
        place = np.array([bases[p] + int(parts[p][3][c]) for p, c, _ in group], np.int64)
        length = np.array([n for *_, n in group])
        found = np.zeros((len(group), int(length.max()), LANES), np.uint32)
        for t in range(int(length.max())):
            live = int(np.searchsorted(-length, -t, "left")) if not long else len(group)
            now = state[:live]
            slot = now & mask
            symbol = table.symbol[slot]
            found[:live, t] = symbol
            now = table.freq[symbol] * (now >> shift) + slot - table.below[symbol]
            short = now < LOW
            taken = np.cumsum(short, axis=1)
            word = stream[np.minimum(place[:live, None] + taken - 1, len(stream) - 1)]
            state[:live] = np.where(short, (now << np.uint64(32)) | word, now)
            place[:live] += taken[:, -1]
        for (p, c, n), ids in zip(group, found, strict=True):
            out[p][c * CHECK * LANES : (c * CHECK + n) * LANES] = ids[:n].ravel()
    return [o[:n] for o, (n, *_) in zip(out, parts, strict=True)]


def to_bytes(frame: Frame, count: int, coded: tuple[np.ndarray, np.ndarray, np.ndarray], table: Frequencies) -> bytes:
    words, states, places = coded
    head = HEAD.pack(
        MAGIC, VERSION, LANES, CHECK, count, frame.start, frame.carried, frame.carried_doc or 0, frame.carried_doc is not None,
        table.bits, len(frame.docs), len(places), len(words),
    )
    body = head + b"".join(
        a.astype(kind).tobytes() for a, kind in
        ((frame.docs, "<i8"), (frame.nulls, "u1"), (frame.at, "<u4"), (states, "<u8"), (places, "<u4"), (words, "<u4"))
    )
    return body + struct.pack("<I", zlib.crc32(body))


def from_bytes(data: bytes, bits: int) -> tuple[Frame, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    if len(data) < HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("A block of token ids is damaged")
    magic, version, lanes, check, count, start, carried, doc, has_doc, of_bits, n_docs, n_places, n_words = HEAD.unpack_from(data)
    if (magic, version, lanes, check, of_bits) != (MAGIC, VERSION, LANES, CHECK, bits):
        raise ValueError("Not a block of token ids for this table")
    at, arrays = HEAD.size, []
    for size, kind in ((n_docs, "<i8"), (n_docs, "u1"), (n_docs, "<u4"), (n_places * LANES, "<u8"), (n_places, "<u4"), (n_words, "<u4")):
        arrays.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    docs, nulls, starts, states, places, words = arrays
    return Frame(start, carried, doc if has_doc else None, docs, nulls, starts), (count, words, states.reshape(-1, LANES), places)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a whole from (crc32, bytes) of its parts: each is moved along by the zero bytes that follow it."""

    def times(matrix: list[int], vector: int) -> int:
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return total

    crc = 0
    for i, (own, size) in enumerate(parts):
        if i == 0:
            crc = own
            continue
        step = [0xEDB88320, *(1 << b for b in range(31))]  # one zero bit
        for _ in range(3):
            step = [times(step, row) for row in step]
        while size:
            if size & 1:
                crc = times(step, crc)
            size >>= 1
            if size:
                step = [times(step, row) for row in step]
        crc ^= own
    return crc
