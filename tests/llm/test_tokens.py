import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpora import awkward
from fleetgauge.llm import range_coder as coder
from fleetgauge.llm.byte_pairs import Decoder, Encoder, Merges, Transducer, encode_and_decode
from fleetgauge.llm.token_files import WordEncoder, _chunks, read_tokens, token_digest, write_tokens
from fleetgauge.session import scratch

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "É", "ß", "İ", "Σ", "ς", "é", "ﬁ", "中", "½", "1", "23", ".", "'s", "'LL", "<|endoftext|>", "<|", " ", "  ", "\n", "\x85", "\xa0", "\x1c", "==", "😀", "the"]


@pytest.fixture(scope="module")
def merges():
    with open(BYTES, encoding="utf-8") as f:
        return Merges(f.read())


def test_any_text_is_encoded_as_the_library_does(merges):
    library, encoder, decoder = Tokenizer.from_file(BYTES), Encoder(merges, limit=50), Decoder(merges, chunk=3)
    with open(WORDS, encoding="utf-8") as f:
        words = WordEncoder(f.read(), limit=50)
    pick = random.Random(1)
    for _ in range(2500):
        text = "".join(pick.choice(ODD) for _ in range(pick.randrange(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, repr(text)
        assert decoder.decode(encoder.encode(text)) == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(words.encode(text), words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("step", [1, 50, 4096])
def test_a_long_piece_is_emitted_before_it_ends(merges, step):
    library, pick = Tokenizer.from_file(BYTES), random.Random(step)
    for letters in ("ab", "the=-", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(pick.choice(letters) for _ in range(3000))
        text = text.replace("=", "e").replace("-", "r")
        stream = Transducer(merges, step)
        early = list(stream.feed(text.encode()))
        assert len(stream.held) < 2 * (merges.lookahead + step)
        assert [*early, *stream.finish()] == library.encode(text, add_special_tokens=False).ids
        assert step > 3000 or early


def test_byte_pairs_of_a_table(documents):
    rows = awkward()
    library = Tokenizer.from_file(BYTES)
    expected = set()
    for d, t in [*rows, (None, "null id"), (3, "again"), (3, "again")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t or ""))
    df = documents([*rows, (None, "null id"), (3, "again"), (3, "again")])
    found = encode_and_decode(df, BYTES).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded) for r in found} == expected and len(found) == len(rows) + 3
    assert encode_and_decode(df.where("false"), BYTES).count() == 0


def test_blocks_go_there_and_back():
    random_ids = np.random.default_rng(0)
    for sizes in ([1], [63, 64, 65], [coder.BLOCK, coder.BLOCK, 300, 16_385]):
        blocks = [np.minimum(random_ids.zipf(1.2, n), 40_000).astype(np.int64) for n in sizes]
        table = coder.Frequencies.of(np.bincount(np.concatenate(blocks), minlength=49_408))
        frames = [
            coder.to_bytes(coder.Frame(7, 3, None, np.arange(2), np.zeros(2), np.arange(2)), len(b), c, table)
            for b, c in zip(blocks, coder.encode_blocks(blocks, table))
        ]
        back = coder.decode_blocks([coder.from_bytes(f, table.bits)[1] for f in frames], table)
        assert all((a == b).all() for a, b in zip(blocks, back))
        with pytest.raises(ValueError):
            coder.from_bytes(frames[0][:40] + bytes([frames[0][40] ^ 1]) + frames[0][41:], table.bits)


def test_checksums_are_joined():
    parts = [b"", b"abc", bytes(1000), b"x" * 77]
    assert coder.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


class Counted(dict):
    def __init__(self, make):
        super().__init__()
        self.make, self.asked = make, []

    def __getitem__(self, key):
        self.asked.append(key)
        return self.make(key)


def test_a_word_of_a_chunk_is_looked_up_once():
    with open(WORDS, encoding="utf-8") as f:
        words = WordEncoder(f.read())
    words.pieces, words.words = Counted(words._piece), Counted(words._word)
    text = "The plain, PLAIN words. 3a again! " * 500
    ids = np.frombuffer(words.encode(text), words.kind).tolist()
    assert ids == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.words.asked == ["3a"]
    assert sorted(words.pieces.asked) == sorted(["the", "plain", "words", "again", "", ",", ".", "!", "3", "a"])


def test_texts_of_a_chunk_keep_their_ids():
    with open(WORDS, encoding="utf-8") as f:
        words = WordEncoder(f.read(), limit=50)
    library, plain = words.tokenizer, [chr(c) for c in range(0x21, 0x180)]
    texts = [None, "", " \t", "\0 a", *(f"{c} {c}! Ab{c} x{c}s {c}'S É{c}?' {c}{c}" for c in plain), "", "x" * 300, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array(["cut off", *texts])], names=["doc_id", "text"]).slice(1)
    for size in (1, 200, 1 << 20):
        found = []
        for part in _chunks(batch, size):
            cuts, ids = words.encode_all(part.column("text"), b"\2\0")
            found += [np.frombuffer(ids.to_pybytes()[a:b], words.kind).tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        assert found == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_token_files_of_a_table(spark, documents):
    pick = random.Random(3)
    long = " ".join(pick.choice(["the", "of", "plain", "words", "x1"]) for _ in range(3 * coder.BLOCK))  # fills blocks alone
    rows = [*awkward(), (20_000, long), (-5, "first"), (20_001, "after")]
    library, expected, at, stream = Tokenizer.from_file(WORDS), set(), 0, []
    for d, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    folder = scratch(spark, "tokens")
    write_tokens(documents(rows), WORDS, folder)
    assert {tuple(r) for r in token_digest(spark, folder).collect()} == expected
    read = sorted(read_tokens(spark, folder).collect(), key=lambda r: r["at"])
    assert np.frombuffer(b"".join(r["ids"] for r in read), "<u4").tolist() == stream


def test_token_files_without_ids_ties_and_rows(spark, documents):
    folder = scratch(spark, "tokens")
    write_tokens(documents([(None, "b"), (4, "same"), (4, "same"), (4, None)]), WORDS, folder)
    rows = sorted(token_digest(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 4, 4, 4] and sum(r.n_tokens == 1 for r in rows) == 1
    empty = scratch(spark, "tokens")
    write_tokens(documents([(1, "a")]).where("false"), WORDS, empty)
    assert token_digest(spark, empty).count() == 0
