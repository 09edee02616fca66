"""Trees of digests over the files of a version."""

from datetime import date

from pyspark.sql import functions as F

from fleetgauge.contracts import NATIONAL
from fleetgauge.session import scratch, settle
from fleetgauge.sources import digest_tree as trees
from fleetgauge.sources import parquet
from rows import frame, reconciled

SCHEMA = "dataset_key string, storage_path string, sha256 string, schema_fingerprint string, byte_size long, row_count long, min_period date, max_period date"
DAY = date(2026, 10, 1)


def manifest(spark, files):
    return spark.createDataFrame([(t, n, s, "f", 10, 1, DAY, None) for t, n, s in files], SCHEMA)


def listed(count=600):
    return [("ab"[i % 3 == 0], f"part-{i}", f"digest {i}") for i in range(count)]


def test_every_node_covers_its_files_and_order_does_not_matter(spark):
    files = listed()
    tree = settle(trees.digest_tree(manifest(spark, files)))
    rows = {(r.dataset_key, r.prefix): r for r in tree.collect()}
    assert rows["a", ""].files == 400 and rows["b", ""].files == 200
    for size in (1, 2):
        assert sum(r.files for (_, p), r in rows.items() if len(p) == size) == 600
    again = trees.digest_tree(manifest(spark, files[::-1]).repartition(7))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.values()}
    whole = trees.root_digest(tree).first()
    assert whole.files == 600 and whole == trees.root_digest(again).first()
    assert trees.root_digest(trees.digest_tree(manifest(spark, files[1:]))).first().digest != whole.digest
    assert trees.root_digest(tree.filter("false")).first().files == 0


def test_only_ranges_that_differ_are_opened(spark):
    files = listed()
    now = [f for f in files if f[1] != "part-7"] + [("a", "part-new", "digest")]
    now = [(t, n, "tampered" if n == "part-30" else s) for t, n, s in now]
    before, after = manifest(spark, files), manifest(spark, now)
    for depth in (1, 2, 3):
        found = trees.differing_ranges(trees.digest_tree(before, depth), trees.digest_tree(after, depth), depth).collect()
        assert 1 <= len(found) <= 3 and {len(r.prefix) for r in found} == {depth}
        faults = {(r.dataset_key, r.storage_path, r.state) for r in trees.differing_files(before, after, depth).collect()}
        assert faults == {("a", "part-7", "missing"), ("a", "part-new", "extra"), ("b", "part-30", "changed")}
    assert trees.differing_files(before, before).count() == 0
    assert trees.differing_files(before, before.filter("dataset_key = 'a'")).select("state").distinct().collect()[0].state == "missing"


def test_stored_files(spark):
    root = scratch(spark, "store")
    rows = reconciled()["national"]
    for row in rows:
        frame(spark, NATIONAL, [row]).coalesce(1).write.mode("append").parquet(parquet.version_path(root, NATIONAL, "v1"))
    frozen = settle(parquet.measure_version(spark, NATIONAL, root, "v1"))
    assert trees.differing_files(frozen, parquet.measure_version(spark, NATIONAL, root, "v1")).count() == 0
    frame(spark, NATIONAL, rows[:1]).coalesce(1).write.mode("append").parquet(parquet.version_path(root, NATIONAL, "v1"))
    now = settle(parquet.measure_version(spark, NATIONAL, root, "v1"))
    assert [r.state for r in trees.differing_files(frozen, now).collect()] == ["extra"]
    assert [r.state for r in trees.differing_files(now, frozen).collect()] == ["missing"]
    changed = now.withColumn("sha256", F.when(F.col("min_period") == rows[1]["period"], F.lit("0")).otherwise(F.col("sha256")))
    assert [r.state for r in trees.differing_files(now, changed).collect()] == ["changed"]
