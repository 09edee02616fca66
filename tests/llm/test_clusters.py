"""Lloyd over shards against plain whole-number arithmetic."""

import hashlib
import math
import random

import pytest

from fleetgauge.llm import sharded_lloyd
from fleetgauge.llm.sharded_lloyd import cluster_vectors

SCHEMA = "label int, vec_id long, embedding array<double>, cluster string, shard int, n int"


def plain_lloyd(rows, clusters=8, rounds=10, width=64, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    by_hash = sorted(kept, key=lambda v: (hashlib.sha256(f"{seed}:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    centroids = [list(e) for _, e in by_hash[:clusters]]

    def near(e):
        return min((sum((x - y) ** 2 for x, y in zip(e, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        at = [near(e)[1] for _, e in kept]
        for k in range(len(centroids)):
            mine = [e for (_, e), a in zip(kept, at) if a == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *near(e)) for i, e in kept]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(d for _, d, _ in last)
    return sorted(((i, k, d, sum(x for _, x, y in last if y == k), whole, names[k]) for i, d, k in last), key=str)


def vectors(spark, rows, parts=3):
    full = [(1, i, e, "c", 9, 8) for i, e in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(5)
    made = [(i, [pick.gauss(i % 7, 0.4) for _ in range(64)]) for i in range(150)]
    made += [(200 + i, made[3][1]) for i in range(80)]  # copies
    made += [(3, made[3][1]), (3, made[4][1]), (None, made[5][1]), (None, made[5][1])]
    made += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [*[1.0] * 63, None])]
    made += [(305, [*[1.0] * 63, math.nan]), (306, [*[1.0] * 63, math.inf]), (307, [-0.0004] * 64), (308, [1e-310] * 64)]
    return made


def test_rounds_are_exact(spark, rows, monkeypatch):
    expected = plain_lloyd(rows)
    for group, shards in ((4096, 4), (16, 4), (7, 1), (16, 64)):
        monkeypatch.setattr(sharded_lloyd.cut_blocks, "__defaults__", (group,))
        assert sorted((tuple(r) for r in cluster_vectors(vectors(spark, rows), shards=shards).collect()), key=str) == expected


def test_other_sizes_ties_and_few_vectors(spark, rows):
    two = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (0, 2), (2, 0), (2, 2), (1, 1), (1, 1)])]
    for clusters in (1, 3, 300):
        found = cluster_vectors(vectors(spark, two), clusters=clusters, rounds=4, width=2, shards=2, seed=1)
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain_lloyd(two, clusters, 4, 2, 1)
    few = rows[:3]
    assert sorted((tuple(r) for r in cluster_vectors(vectors(spark, few)).collect()), key=str) == plain_lloyd(few)
    none = cluster_vectors(vectors(spark, rows[-9:-3]))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_that_do_not_fit(spark):
    with pytest.raises(Exception, match="would not fit"):
        cluster_vectors(vectors(spark, [(1, [1e30] * 64)])).collect()


def test_tables_are_dropped(spark, rows):
    before = {t.name for t in spark.catalog.listTables()}
    cluster_vectors(vectors(spark, rows)).count()
    assert {t.name for t in spark.catalog.listTables()} == before
