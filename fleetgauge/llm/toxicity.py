"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

1. Over all labelled training rows, count in how many toxic and in how many other documents each hashed n-gram
   occurs; the smoothed log ratio of the two shares is its naive Bayes weight.
2. Every n-gram whose shares are ``evidence`` standard errors or more apart has a weight, however many these are. A logistic
   regression is fitted on their presence times their ratio, over at most ``max_rows`` rows of either class.
3. Every document is scored by the n-grams it has, over its whole text.

Counts cover all labelled rows; the fit's sample is bounded by ``max_rows``.

Defined results: a null text is empty; an empty text scores the intercept. A null doc_id is crc32 of the empty text.
Labels other than 0 and 1 are left out. With one class or none, every score is the share of toxic labels (0.0 without labels).
Repeated rows each get a row; a doc_id with several labels trains once for each. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import written

BITS = 20
ORDERS = (3, 4, 5)
PIECE = 1 << 20
EVIDENCE, STRENGTH = 2.0, 1e-3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one for each hash, 0 for n-grams not selected
    intercept: float


def _characters(text: str | None) -> np.ndarray:
    squeezed = " ".join((text or "").lower().split())
    return np.frombuffer(f" {squeezed} ".encode("utf-32-le", "surrogatepass"), "<u4")


def _hashes(points: np.ndarray, order: int) -> np.ndarray:
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x1E3779B1, np.uint32)
    for i in range(order):
        h = (h ^ points[i : n + i]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def present(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct n-gram hashes of a text; those in ``wanted`` (a mask) if given. Long texts go piece by piece."""
    points = _characters(text)
    found = []
    for low in range(0, max(1, len(points)), PIECE):
        piece = points[low : low + PIECE + max(ORDERS) - 1]
        for order in ORDERS:
            h = _hashes(piece, order)
            found.append(np.unique(h if wanted is None else h[wanted[h]]))
    return np.unique(np.concatenate(found))


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def count_ngrams(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many other and toxic rows of (text, toxic) each hash occurs (2 by 2^BITS), and the rows of both kinds.

    A task sends the hashes it has met, and the number of rows under hash -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic, present(text)] += 1
                rows[toxic] += 1
        met = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(met, -1), pa.int32()), *[pa.array(np.append(counts[k, met], rows[k]), pa.int64()) for k in (0, 1)]],
            names=["hash", "others", "toxic"],
        )

    met = train.select("text", "toxic").mapInArrow(run, "hash int, others long, toxic long")
    found = met.groupBy("hash").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic")).toArrow()  # 2^BITS rows at most
    at = found.column("hash").to_numpy()
    pairs = np.stack([found.column(n).to_numpy() for n in ("others", "toxic")])
    counts = np.zeros((2, 1 << BITS), np.int64)
    counts[:, at[at >= 0]] = pairs[:, at >= 0]
    return counts, pairs[:, at < 0].sum(axis=1)


def log_count_ratios(counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log ratio of the smoothed shares of toxic and other rows that hold each hash, and how many standard errors they are apart."""
    shares = (counts + 0.5) / (rows[:, None] + 1)
    apart = np.abs(shares[1] - shares[0]) / np.sqrt((shares[0] + shares[1]) * (1 / rows).sum())
    return np.log(shares[1] / shares[0]), apart


def _minimum(value_and_gradient: Callable, start: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking."""
    x, steps = start, []
    value, gradient = value_and_gradient(x)
    for _ in range(rounds):
        direction, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            direction += s * (a - (y @ direction) / (s @ y))
        slope, size = gradient @ direction, 1.0 if steps else 1.0 / max(1.0, float(np.linalg.norm(gradient)))
        for _ in range(30):
            moved = x - size * direction
            new_value, new_gradient = value_and_gradient(moved)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = moved - x, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, gradient = moved, new_value, new_gradient
        if done:
            break
    return x


def _logistic(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, strength: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio; both classes weigh the same. Weights over the selected n-grams, and the intercept."""
    rows = np.repeat(np.arange(len(x)), [len(i) for i in x])
    columns = np.concatenate(x)
    values = ratio[columns]
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    sign = np.where(y == 1, 1.0, -1.0)

    def value_and_gradient(weights: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (np.bincount(rows, values * weights[columns], len(x)) + weights[-1])
        loss = share @ np.logaddexp(0, -margin) + strength / 2 * (weights[:-1] @ weights[:-1])
        pull = -share * sign / (1 + np.exp(np.clip(margin, -40, 40)))
        gradient = np.append(np.bincount(columns, values * pull[rows], len(ratio)) + strength * weights[:-1], pull.sum())
        return float(loss), gradient

    found = _minimum(value_and_gradient, np.zeros(len(ratio) + 1), rounds)
    return found[:-1], float(found[-1])


def _sample(train: DataFrame, max_rows: int) -> DataFrame:
    """Up to ``max_rows`` texts of either class: chosen by narrow keys, so texts stay where they are until they are."""
    keyed = train.withColumn("key", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("t")))
    chosen = [keyed.where(F.col("toxic") == k).select("toxic", "key").distinct().orderBy("key").limit(max_rows) for k in (0, 1)]
    keys = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by max_rows
    return keyed.join(keys, ["toxic", "key"], "left_semi").dropDuplicates(["toxic", "key"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2_000, evidence: float = EVIDENCE, small: int = 2_000_000) -> Model:
    """``small``: up to so many labels are sent to every task; more of them are joined by a shuffle."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    wanted = wanted.where(F.col("toxic").isin(0, 1) & (F.crc32(id_text) % 5 != 0))
    if wanted.count() <= small:
        wanted = F.broadcast(wanted)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id")
    train = written(train.select("doc_id", "text", "toxic"), "toxic-training")
    counts, rows = count_ngrams(train)
    if not rows.all():
        return Model(np.zeros(1 << BITS, np.float32), 40.0 if rows[1] else -40.0)
    ratio, apart = log_count_ratios(counts, rows)
    keep = np.flatnonzero(apart >= evidence)
    place = np.full(1 << BITS, -1, np.int64)
    place[keep] = np.arange(len(keep))
    mask = place >= 0

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "found": [place[present(t, mask)].astype("<i4").tobytes() for t in frame["text"]]})

    sampled = _sample(train, max_rows).mapInPandas(chosen, "toxic int, found binary").collect()
    sampled.sort(key=lambda r: (r.toxic, bytes(r.found)))  # the fit does not depend on the order of tasks
    x = [np.frombuffer(r.found, "<i4").astype(np.int64) for r in sampled]
    weights, intercept = _logistic(x, np.array([r.toxic for r in sampled]), ratio[keep], STRENGTH, 100)
    full = np.zeros(1 << BITS, np.float32)
    full[keep] = (weights * ratio[keep]).astype(np.float32)
    return Model(full, float(intercept))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = held.value
        mask = weights != 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            total = np.array([intercept + float(weights[present(t, mask)].sum(dtype=np.float64)) for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(score, pa.float64()),
                 pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
