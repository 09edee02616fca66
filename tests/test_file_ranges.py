"""Ranges of files, folded digests, and files too large for one value."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from fleetgauge.sources import exports
from fleetgauge.sources import file_ranges as ranges

MB = 1 << 20


def filled(folder, name, size, seed=1):
    data = bytes((i * i * seed + i) % 251 for i in range(4_096)) * (size // 4_096 + 1)
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data[:size])
    return data[:size]


def test_a_file_of_several_ranges_is_read_in_one_query(spark, tmp_path):
    data = filled(tmp_path, "large.bin", 5 * MB + 17)
    found = ranges.range_digests(spark, str(tmp_path), MB, 2 * MB)
    assert found.rdd.getNumPartitions() == 3
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [
        ("large.bin", at, len(data[at:at + MB]), hashlib.sha256(data[at:at + MB]).hexdigest()) for at in range(0, len(data), MB)
    ]
    assert max(r[2] for r in rows) == MB


def test_names_hidden_empty_and_nested_files(spark, tmp_path):
    filled(tmp_path, "a b%20c.txt", 10)
    filled(tmp_path, "deep/er/ü.txt", 11)
    filled(tmp_path, "empty.txt", 0)
    filled(tmp_path, "other.csv", 5)
    for hidden in ("_SUCCESS", ".part.crc", "_temporary/x.txt"):
        filled(tmp_path, hidden, 3)
    found = ranges.range_digests(spark, f"file:{tmp_path}/", 100, suffix=".txt").select("path", "length").collect()
    assert sorted(map(tuple, found)) == [("a b%20c.txt", 10), ("deep/er/ü.txt", 11), ("empty.txt", 0)]
    bare = tmp_path / "none"
    bare.mkdir()
    assert ranges.range_digests(spark, str(bare)).count() == 0
    with pytest.raises(Exception, match="rangeBytes"):
        ranges.range_digests(spark, str(tmp_path), 0).collect()


def test_packing_covers_every_byte_once_and_bounds_partitions():
    files = [("a", 0), ("b", 5), ("c", 1_000), ("d", 64), ("e", 65), *[(f"s{i:03}", 3) for i in range(300)]]
    packed = ranges.pack(files, 16, 64)
    covered = {}
    for partition in packed:
        assert sum(stop - start for _, start, stop in partition.spans) <= 64
        for path, start, stop in partition.spans:
            assert start % 16 == 0 and start == covered.get(path, 0)
            covered[path] = stop
    assert covered == dict(files)
    assert ranges.pack([], 16, 64) == []
    # A range larger than a partition is still read as one.
    assert [p.spans for p in ranges.pack([("a", 40)], 100, 10)] == [[("a", 0, 40)]]


def test_only_the_ranges_that_changed_are_named(spark, tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    for folder in (old, new):
        filled(folder, "same", 2_500)
        filled(folder, "edited", 5_000)
        filled(folder, "shorter", 3_000)
    filled(old, "gone", 10)
    filled(new, "added", 10)
    with open(new / "edited", "r+b") as file:
        file.seek(2_500)
        file.write(b"\xff")
    os.truncate(new / "shorter", 1_500)
    before, after = (ranges.range_digests(spark, str(folder), 1_000) for folder in (old, new))
    assert sorted(map(tuple, ranges.differing_ranges(before, after).collect())) == [
        ("added", 0, "extra"), ("edited", 2_000, "changed"), ("gone", 0, "missing"),
        ("shorter", 1_000, "changed"), ("shorter", 2_000, "missing"),
    ]
    folded = {r.path: r for r in ranges.folded_digests(before).collect()}
    again = {r.path: r for r in ranges.folded_digests(after.repartition(5)).collect()}
    assert folded["same"] == again["same"] and (folded["same"].byte_size, folded["same"].ranges) == (2_500, 3)
    assert folded["edited"].folded_sha256 != again["edited"].folded_sha256


def test_large_files_are_streamed_with_the_same_digests(spark, tmp_path):
    want = {}
    for name, size in (("small", 10), ("at the limit", 4_096), ("über", 3 * MB + 5)):
        want[name] = (size, hashlib.sha256(filled(tmp_path, name, size)).hexdigest())
    filled(tmp_path, "empty", 0)  # not listed
    streamed = ranges.file_digests(spark, str(tmp_path), whole_bytes=4_096)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    assert {r.file: (r.length, r.sha256) for r in streamed.select(name, "length", "sha256").collect()} == want
    # Neither the listing of large files nor that of small ones loads the content of the other.
    plan = streamed._jdf.queryExecution().toString()
    assert all(f"PushedFilters: [IsNotNull(length), {test}(length,4096)]" in plan for test in ("LessThanOrEqual", "GreaterThan"))
    registry = spark.createDataFrame([(n, n, *facts) for n, facts in want.items()], "file string, role string, bytes long, sha256 string")
    assert exports.verify_inputs(spark, str(tmp_path), registry, whole_bytes=100).count() == 0
    with open(tmp_path / "über", "r+b") as file:
        file.seek(2 * MB)
        file.write(b"\xff\xfe")
    assert [(r.file, r.problem) for r in exports.verify_inputs(spark, str(tmp_path), registry, whole_bytes=100).collect()] == [("über", "changed")]
