"""Centroid clustering with the dimensions dealt to shards.

Vectors become whole numbers, and groups of a few thousand vectors are cut into blocks of columns. A block is a row of
a bucketed table, dealt by (shard, group), so a task holds some columns of many vectors and needs only that slice of the
centroids. In a round each block yields its exact partial distances; these are added by group, where the least sum
gives the assignment; the assignments (one byte or two a vector and shard) go back to the blocks, and each shard
adds up its own slice of every cluster. Blocks are shuffled once, when the table is written. The driver holds the centroids,
whose number and width are parameters, and nothing that grows with the vectors.

Every round starts from the written table and the centroids alone, so lineage does not grow and a lost executor repeats
no more than its part of one round.

Defined results: vectors of another width, with null or non-finite components, or null themselves, are left out.
Components are floor(scale * x) and must lie within 2^27, since distances are longs; a larger one stops the job with
an error. Fewer vectors than clusters give as many clusters as vectors. Repeated rows, also of one vec_id, are vectors of
their own; equal hashes are ordered by the components. A null vec_id is hashed as an empty one. Ties go to the smaller number. No vectors give no rows.
Only vec_id and embedding are read; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import IN_PART, map_arrow, written
from fleetgauge.session import scratch

SCALE, CLUSTERS, ROUNDS, WIDTH, SHARDS = 1024, 8, 10, 64, 4
GROUP = 4096  # vectors of a block
BUCKET_BYTES = 128 << 20
MOST = 1 << 27
BLOCKS = "group long, shard int, n int, cells binary, ids array<long>"


def fit_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(
        (F.size(e) == width) & ~F.coalesce(odd, F.lit(False))
    )


def _hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def first_centroids(vectors: DataFrame, clusters: int, scale: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes, in the order of these: each task keeps ``clusters`` of them."""
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))))
    found = vectors.select(_hash(seed).alias("hash"), whole.alias("cells")).orderBy("hash", "cells").limit(clusters).collect()
    return np.array([[int(x) for x in r.cells] for r in found], np.int64)


def _spans(width: int, shards: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, width, shards + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def cut_blocks(vectors: DataFrame, width: int, scale: int, shards: int, group: int = GROUP) -> DataFrame:
    """Blocks of columns of groups of vectors; the first shard's block carries the ids."""
    spans = _spans(width, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << IN_PART
        for batch in batches:
            ids, data = batch.column(0), batch.column(1)
            cells = np.floor(data.flatten().to_numpy(zero_copy_only=False) * float(scale)).reshape(len(batch), width)
            if len(cells) and np.abs(cells).max() > MOST:
                raise ValueError(f"A component beyond {MOST} after scaling by {scale}: distances would not fit a long")
            for low in range(0, len(batch), group):
                part = cells[low : low + group].astype("<i4")
                blocks = [np.ascontiguousarray(part[:, a:b]).tobytes() for a, b in spans]
                names = [ids.slice(low, group), *[None] * (shards - 1)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "group": pa.array([number] * shards, pa.int64()),
                        "shard": pa.array(range(shards), pa.int32()),
                        "n": pa.array([len(part)] * shards, pa.int32()),
                        "cells": pa.array(blocks, pa.binary()),
                        "ids": pa.array([None if x is None else x.to_pylist() for x in names], pa.list_(pa.int64())),
                    }
                )
                number += 1

    return vectors.mapInArrow(run, BLOCKS)


def store_blocks_of_columns(vectors: DataFrame, rows: int, width: int, scale: int, shards: int) -> tuple[DataFrame, int, str]:
    """The blocks as a table bucketed by (shard, group), the number of buckets (from the bytes), and the table's name."""
    spark = vectors.sparkSession
    # Four bytes a component; at least two buckets a core, and no more than Spark allows.
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-rows * width * 4 // BUCKET_BYTES))
    buckets = min(buckets, shards * -(-rows // GROUP) + shards, 50_000)
    name = f"columns_{uuid.uuid4().hex}"
    (
        cut_blocks(vectors, width, scale, shards).repartition(buckets, "shard", "group")
        .write.format("parquet").option("compression", "zstd").option("path", scratch(spark, "columns"))
        .bucketBy(buckets, "shard", "group").saveAsTable(name)
    )
    return spark.table(name), buckets, name


def _matrix(block: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(block, "<i4").reshape(n, width).astype(np.int64)


def partial_distances(blocks: DataFrame, centroids: np.ndarray, shards: int) -> DataFrame:
    """The squared distances of a block to every centroid, as far as its columns go; as narrow as they fit."""
    spans = _spans(centroids.shape[1], shards)
    slices = [centroids[:, a:b] for a, b in spans]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i] for c in ("group", "shard", "n", "ids")}
            mine = slices[row["shard"].as_py()]
            x = _matrix(batch.column("cells")[i].as_buffer(), row["n"].as_py(), mine.shape[1])
            parts = np.stack([((x - c) ** 2).sum(axis=1) for c in mine])
            kind = "<u4" if parts.max(initial=0) < 1 << 32 else "<i8"
            yield pa.RecordBatch.from_pydict(
                {
                    "group": pa.array([row["group"].as_py()], pa.int64()),
                    "n": pa.array([row["n"].as_py()], pa.int32()),
                    "parts": pa.array([parts.astype(kind).tobytes()], pa.binary()),
                    "ids": pa.array([row["ids"].as_py()], pa.list_(pa.int64())),
                }
            )

    return map_arrow(blocks, run, "group long, n int, parts binary, ids array<long>")


def _nearest(table: pa.Table, clusters: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Group, assignment and distance from the partial distances of its shards."""
    n = table.column("n")[0].as_py()
    total = np.zeros((clusters, n), np.int64)
    for parts in table.column("parts"):
        data = parts.as_buffer()
        total += np.frombuffer(data, "<u4" if data.size == 4 * total.size else "<i8").reshape(total.shape)
    nearest = total.argmin(axis=0)  # the first of equals
    return table.column("group")[0].as_py(), nearest, total[nearest, np.arange(n)]


def assignments(partial: DataFrame, clusters: int) -> DataFrame:
    """(group, chosen): partial distances added by group, and the number of the least for every vector."""
    kind = "<u1" if clusters <= 256 else "<u4"

    def run(table: pa.Table) -> pa.Table:
        group, nearest, _ = _nearest(table, clusters)
        return pa.table({"group": pa.array([group], pa.int64()), "chosen": pa.array([nearest.astype(kind).tobytes()], pa.binary())})

    return partial.select("group", "n", "parts").groupBy("group").applyInArrow(run, "group long, chosen binary")


def shard_sums(blocks: DataFrame, chosen: DataFrame, clusters: int, width: int, shards: int) -> DataFrame:
    """(shard, cluster, n, sums): what each shard's columns add up to in every cluster."""
    spans, kind = _spans(width, shards), "<u1" if clusters <= 256 else "<u4"
    sent = chosen.select("group", "chosen", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    met = blocks.select("group", "shard", "n", "cells").join(sent.hint("shuffle_hash"), ["shard", "group"]).select(
        "shard", "n", "cells", "chosen"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts = np.zeros((shards, clusters), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                shard, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                a, b = spans[shard]
                x = _matrix(batch.column(2)[i].as_buffer(), n, b - a)
                at = np.frombuffer(batch.column(3)[i].as_buffer(), kind)
                mine = sums.setdefault(shard, np.zeros((clusters, b - a), np.int64))
                for c in np.unique(at).tolist():
                    mine[c] += x[at == c].sum(axis=0)
                counts[shard] += np.bincount(at, minlength=clusters)
        for shard, found in sums.items():
            used = np.flatnonzero(counts[shard]).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard] * len(used), pa.int32()),
                    "cluster": pa.array(used, pa.int32()),
                    "n": pa.array(counts[shard][used], pa.int64()),
                    "sums": pa.array([found[c].tolist() for c in used], pa.list_(pa.int64())),
                }
            )

    partial = met.mapInArrow(run, "shard int, cluster int, n long, sums array<long>")
    return (
        partial.select("shard", "cluster", "n", F.posexplode("sums"))
        .groupBy("shard", "cluster", "pos")
        .agg(F.sum("n").alias("n"), F.sum("col").alias("total"))
    )


def updated(centroids: np.ndarray, sums: DataFrame, shards: int) -> np.ndarray:
    """New centroids, slice by slice; a cluster without vectors keeps its place."""
    spans, out = _spans(centroids.shape[1], shards), centroids.copy()
    for r in sums.collect():  # clusters times width numbers
        out[r.cluster, spans[r.shard][0] + r.pos] = r.total // r.n
    return out


def _members(partial: DataFrame, clusters: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        _, nearest, distance = _nearest(table, clusters)
        ids = next(x for x in table.column("ids") if x.is_valid)
        return pa.table({"vec_id": ids.values, "cluster": pa.array(nearest, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return partial.groupBy("group").applyInArrow(run, "vec_id long, cluster int, distance long")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE,
    seed: int = 3, shards: int = SHARDS,
) -> DataFrame:
    """The cluster of every vector after ``rounds`` rounds, its squared distance, and digests of the outcome."""
    spark = vectors.sparkSession
    fit = fit_vectors(vectors, width)
    centroids = first_centroids(fit, clusters, scale, seed)
    clusters = len(centroids)
    if not clusters:
        return spark.createDataFrame([], RESULT)
    blocks, _, name = store_blocks_of_columns(fit, fit.count(), width, scale, shards)
    for _ in range(rounds):
        chosen = assignments(partial_distances(blocks, centroids, shards), clusters)
        after = updated(centroids, shard_sums(blocks, chosen, clusters, width, shards), shards)
        if (after == centroids).all():
            break  # every further round would repeat this one
        centroids = after
    members = written(_members(partial_distances(blocks, centroids, shards), clusters), "members")
    spark.sql(f"drop table {name}")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    # One row for each cluster.
    totals = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = members.agg(F.sum("distance").alias("inertia"))
    summary = spark.createDataFrame(totals.join(named, "cluster").collect(), "cluster int, cluster_inertia long, centroid_sha256 string")
    return members.join(F.broadcast(summary.withColumn("inertia", F.lit(every.first().inertia))), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
