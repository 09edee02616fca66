"""Language-model scores of documents: the probability of a text summed over all its segmentations into subwords.

The vocabulary and its scores exist already (a SentencePiece model); it is never trained. What is learned from the training
documents is how often its pieces are used: their words are counted exactly, and the scores weight all
segmentations of every distinct word (forwards and backwards, in log space), which gives the expected count of each
piece. No piece crosses a space, so the lattice of a document is the lattices of its words in a row, and its marginal
probability is the product of theirs and of the end. Every distinct word of the corpus goes through the recursion once.

Words that make up a hundred-thousandth of all tokens or more are a hundred thousand at most and are sent to all
tasks, as at most 64 bytes each; so a word that stands in every document never meets in one task. All
others are sent to their counts as (document, word, how often), and each has few rows by definition.

Defined results: a null text is empty, and has the end alone. A null doc_id counts as an empty text for the
choice of the training documents, so its row trains. Repeated rows each count and each get a row. Without training documents all counts are
0 and the given scores stand alone. A word may be of any length: above 64 bytes it is known by its SHA-256 and kept once, with
its text; memory is some 500 bytes for each byte of the longest word. An empty table gives no rows. Only doc_id and text are
read; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import exp, inf, log, log1p, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import as_bytes, written

END = b" "  # no word: words hold no spaces
LONG = 64  # bytes from which a word is known by its digest
HOT_SHARE = 100_000
HELD = 1 << 19  # words that a task counts before it hands them on
UNIT = 1 << 16  # expected counts are added as whole numbers of this part, so that their order does not matter
SMOOTHING = 1.0
WORDS_A_TASK = 200_000
BATCH_BYTES = 1 << 18  # of words whose lattices are summed side by side
ROUNDS = 2  # of re-estimation; on invented prose the second gains 3 %, the third 1 %
_tries: dict[bytes, Trie] = {}


def held_out(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII spaces, with A-Z in lower case."""
    return as_bytes(text).lower().split()


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONG else END + hashlib.sha256(word).digest()


# --- the lattice ------------------------------------------------------------------


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """(bytes, log weight) of the pieces of a SentencePiece file, spaces as spaces, with a piece for each byte.

    Scores of a unigram file are log probabilities. A file of merges has ranks instead (0, -1, -2, …): the weight is
    then that of the rank in a Zipf distribution. Bytes weigh least. Pieces with spaces past their start never fit and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [
        (model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
    ]
    usual = [(piece, score) for piece, score in usual if piece and b" " not in piece[1:]]
    if all(score == int(score) for _, score in usual):
        usual = [(piece, -log(1 - score)) for piece, score in usual]
    least = min(score for _, score in usual)
    return usual + [(bytes([b]), least) for b in range(256)]


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    if x < y:
        x, y = y, x
    return x if y == -inf else x + log1p(exp(y - x))


class Trie:
    """Pieces as paths from node 0: ``after[node, byte]`` is the next node, 0 where no piece goes on."""

    def __init__(self, pieces: Sequence[bytes]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                nodes.setdefault(piece[:end], len(nodes))
        self.after = np.zeros((len(nodes), 256), np.int32)
        for path, node in nodes.items():
            if path:
                self.after[nodes[path[:-1]], path[-1]] = node
        self.piece_at = np.full(len(nodes), -1, np.int32)
        self.piece_at[[nodes[p] for p in pieces]] = np.arange(len(pieces))

    @classmethod
    def of(cls, pieces: Sequence[bytes]) -> Trie:
        """Built once in a process: weights change between rounds, pieces do not."""
        key = hashlib.md5(b"\0".join(pieces)).digest()
        if key not in _tries:
            _tries.clear()
            _tries[key] = cls(pieces)
        return _tries[key]


@dataclass
class Arcs:
    """The lattices of many texts side by side: an arc for each place where a piece fits.

    A text of n bytes has n + 1 vertices in a row. ``source`` and ``target`` number vertices over all texts.
    """

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    place: np.ndarray  # of a vertex, in its text
    first: np.ndarray  # vertex of each text
    last: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[bytes], trie: Trie) -> Arcs:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        number = np.repeat(np.arange(len(texts)), sizes)
        at, stop = np.arange(len(data)), np.cumsum(sizes)[number]
        node, length, found = trie.after[0, data], 1, []
        while len(at):
            piece = trie.piece_at[node]
            fits = np.flatnonzero(piece >= 0)
            source = at[fits] + number[at[fits]]
            found.append((source, source + length, piece[fits]))
            more = np.flatnonzero(at + length < stop[at])
            at, node = at[more], node[more]
            node = trie.after[node, data[at + length]]
            on = np.flatnonzero(node)
            at, node, length = at[on], node[on], length + 1
        first = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(len(data) + len(texts)) - np.repeat(first, sizes + 1)
        parts = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)]
        return cls(*parts, place, first, first + sizes)

    def sums(self, weights: np.ndarray, forwards: bool) -> np.ndarray:
        """For every vertex the log of the summed probability of all ways from its text's start to it (or from it to the end).

        Vertices of one place in their texts are summed at once, place after place.
        """
        into, out = (self.target, self.source) if forwards else (self.source, self.target)
        order = np.argsort(self.place[into] * len(self.place) + into, kind="stable")
        into, out, weights = into[order], out[order], weights[order]
        heads = np.flatnonzero(np.diff(into, prepend=-1))
        counts = np.diff(heads, append=len(into))
        places = self.place[into[heads]]
        steps = np.flatnonzero(np.diff(places, prepend=-1)).tolist()
        value = np.full(len(self.place), -inf)
        value[self.first if forwards else self.last] = 0.0
        blocks = list(zip(steps, [*steps[1:], len(heads)], strict=True))
        for a, b in blocks if forwards else reversed(blocks):
            low, high = heads[a], heads[b - 1] + counts[b - 1]
            x = value[out[low:high]] + weights[low:high]
            at = heads[a:b] - low
            top = np.maximum.reduceat(x, at)
            value[into[heads[a:b]]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, counts[a:b])), at))
        return value


class Lattice:
    """Pieces with log probabilities. All single bytes must be among them, so every text has a segmentation."""

    def __init__(self, pieces: Sequence[bytes], weights: np.ndarray) -> None:
        self.pieces, self.weights = list(pieces), weights
        self.longest = max(map(len, self.pieces))

    @classmethod
    def of(cls, pieces: Sequence[tuple[bytes, float]]) -> Lattice:
        """A piece that is also a byte's has the probability of both."""
        weights: dict[bytes, float] = {}
        for piece, weight in pieces:
            weights[piece] = _add(weights.get(piece, -inf), weight)
        return cls(list(weights), np.array(list(weights.values())))

    def _batches(self, texts: Sequence[bytes]) -> Iterator[tuple[int, Arcs]]:
        """(number of the first text, arcs) of runs of texts of bounded size; a very long text stands alone."""
        trie, low, size = Trie.of(self.pieces), 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > BATCH_BYTES:
                yield low, Arcs.of(texts[low:i], trie)
                low, size = i, 0
            size += len(text)
        if size:
            yield low, Arcs.of(texts[low:], trie)

    def log_probabilities(self, texts: Sequence[bytes]) -> np.ndarray:
        """The marginal log probability of each text, none of which is empty."""
        out = np.zeros(len(texts))
        for low, arcs in self._batches(texts):
            out[low : low + len(arcs.last)] = arcs.sums(self.weights[arcs.piece], True)[arcs.last]
        return out

    def expected(self, texts: Sequence[bytes], times: np.ndarray) -> np.ndarray:
        """Uses of every piece in all texts, on average over the segmentations, in units of 1 / UNIT."""
        total = np.zeros(len(self.pieces), np.int64)
        for low, arcs in self._batches(texts):
            weights = self.weights[arcs.piece]
            alpha, beta = arcs.sums(weights, True), arcs.sums(weights, False)
            number = np.repeat(np.arange(len(arcs.first)), arcs.last - arcs.first + 1)[arcs.source]
            share = np.exp(alpha[arcs.source] + weights + beta[arcs.target] - alpha[arcs.last[number]])
            np.add.at(total, arcs.piece, np.rint(share * times[low + number] * UNIT).astype(np.int64))
        return total


# --- counts -----------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """(key, long, trained, seen) of all words of (text, held) and of the end: occurrences in training documents, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter[bytes] = Counter()
        others: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(trained.keys() | others.keys())
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([key_of(w) for w in words], pa.binary()),
                    pa.array([w if len(w) > LONG else None for w in words], pa.binary()),
                    pa.array([trained[w] for w in words], pa.int64()),
                    pa.array([trained[w] + others[w] for w in words], pa.int64()),
                ],
                names=["key", "long", "trained", "seen"],
            )
            trained.clear()
            others.clear()
            return batch

        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                into = others if held else trained
                into.update(words_of(text.as_py()))
                into[END] += 1
                if len(trained) + len(others) > HELD:
                    yield flush()
        yield flush()

    counted = docs.mapInArrow(run, "key binary, long binary, trained long, seen long")
    return counted.groupBy("key", "long").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    """Words as the lattice reads them, with the space before."""
    return [END + (whole or key) for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]


def expected_pieces(words: DataFrame, lattice: Lattice) -> np.ndarray:
    """Expected uses of the pieces in the training words; no more numbers than the vocabulary has pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.pieces), np.int64)
        for batch in batches:
            total += lattice.expected(_texts(batch), batch.column(2).to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["piece", "uses"])

    used = words.where((F.col("trained") > 0) & (F.col("key") != F.lit(END))).select("key", "long", "trained")
    out = np.zeros(len(lattice.pieces))
    for r in used.mapInArrow(run, "piece int, uses long").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        out[r.piece] = r.uses / UNIT
    return out


@dataclass
class Model:
    """Log probabilities of pieces and of the end, and the training counts that plain word scores need."""

    lattice: Lattice
    end: float
    tokens: int
    types: int
    words: DataFrame  # key, trained, seen, score (natural log)
    hot: dict[bytes, tuple[int, float]]


def _given(lattice: Lattice) -> tuple[Lattice, float]:
    """The given weights as probabilities; the end weighs as little as the least piece."""
    least = lattice.weights.min()
    total = log(np.exp(lattice.weights).sum() + exp(least))
    return Lattice(lattice.pieces, lattice.weights - total), least - total


def _estimated(pieces: Sequence[bytes], uses: np.ndarray, ends: int) -> tuple[Lattice, float]:
    """Probabilities from counts; every piece and the end have been seen SMOOTHING times more."""
    total = log(uses.sum() + ends + SMOOTHING * (len(pieces) + 1))
    return Lattice(pieces, np.log(uses + SMOOTHING) - total), log(ends + SMOOTHING) - total


def learn(docs: DataFrame, path: str, rounds: int = ROUNDS) -> Model:
    """Train on the rows of (text, held) that are not held; ``words`` holds all rows' words."""
    spark = docs.sparkSession
    found = written(count_words(docs), "words")
    facts = found.agg(
        F.coalesce(F.sum("trained"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("trained") > 0, 1)).alias("types"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.count("*").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("key") == F.lit(END), F.col("trained"))), F.lit(0)).alias("ends"),
    ).first()
    # The recursion is the work, so tasks are cut by words, not by bytes.
    spread = found.repartition(max(spark.sparkContext.defaultParallelism, facts.rows // WORDS_A_TASK), "key")
    lattice, end = _given(Lattice.of(vocabulary(path)))
    for _ in range(rounds if facts.ends else 0):
        lattice, end = _estimated(lattice.pieces, expected_pieces(spread, lattice), facts.ends)
    words = written(_scored(spread, lattice), "scored-words")
    hot = words.where((F.col("seen") * HOT_SHARE >= F.lit(facts.seen)) & (F.col("key") != F.lit(END)))
    return Model(
        lattice, end, facts.tokens, facts.types, words, {bytes(r.key): (r.trained, r.score) for r in hot.select("key", "trained", "score").collect()}
    )


def _scored(words: DataFrame, lattice: Lattice) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = lattice.log_probabilities(_texts(batch))  # the end's is never read
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(scores, pa.float64())],
                names=["key", "trained", "seen", "score"],
            )

    return words.select("key", "long", "trained", "seen").mapInArrow(run, "key binary, trained long, seen long, score double")


# --- documents --------------------------------------------------------------------

PARTS = "row long, doc_id string, held boolean, n_tokens long, n_known long, plain double, score double, rest array<struct<key:binary,times:int>>"


def part_scores(docs: DataFrame, hot: dict[bytes, tuple[int, float]], trained_ends: int) -> DataFrame:
    """What the frequent words and the end give to each document, and its other words with their number."""
    logs = {w: (c, log10(c + 1), s) for w, (c, s) in hot.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        end_known, end_log = int(trained_ends > 0), log10(trained_ends + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            keys: list[bytes] = []
            times: list[int] = []
            ends = [0]
            for text in batch.column(1):
                n, known, plain, score = 1, end_known, end_log, 0.0
                for word, k in Counter(words_of(text.as_py())).items():
                    n += k
                    if (at := logs.get(word if len(word) <= LONG else key_of(word))) is None:
                        keys.append(key_of(word))
                        times.append(k)
                    else:
                        known += k if at[0] else 0
                        plain += k * at[1]
                        score += k * at[2]
                ends.append(len(keys))
                for column, value in zip(out, (row, n, known, plain, score), strict=False):
                    column.append(value)
                row += 1
            rest = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(times, pa.int32())], names=["key", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()), batch.column(0), batch.column(2), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest),
                ],
                names=[c.split()[0] for c in PARTS.split(", ")],
            )

    return docs.mapInArrow(run, PARTS)


def score_documents(docs: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word counts) and score (the lattice), in log10."""
    kind = docs.schema["doc_id"].dataType
    told = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held")
    )
    model = learn(told.select("text", "held"), path, rounds)
    ends = model.words.where(F.col("key") == F.lit(END)).select("trained").first()
    parts = written(part_scores(told, model.hot, ends.trained if ends else 0), "part-scores")
    rest = (
        parts.select("row", F.explode("rest").alias("w"))
        .select("row", "w.key", "w.times")
        .join(model.words.select("key", "trained", F.col("score").alias("each")), "key")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(F.col("trained") + 1)).alias("more_plain"),
            F.sum(F.col("times") * F.col("each")).alias("more_score"),
        )
    )
    all_counts = log10(model.tokens + model.types + 1)
    zero = F.lit(0.0)
    return parts.drop("rest").join(rest, "row", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("plain") + F.coalesce("more_plain", zero) - F.col("n_tokens") * F.lit(all_counts)).alias("base_score"),
        ((F.col("score") + F.coalesce("more_score", zero) + F.lit(model.end)) / F.lit(log(10.0))).alias("score"),
    )

