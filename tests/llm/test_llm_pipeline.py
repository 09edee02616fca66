import os
import subprocess
import sys

import pytest

import brute
import corpus_pipeline
from fleetgauge.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_stages_do_what_they_say(spark):
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "byte_pairs":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            passed = {d for d, t in before.items() if not brute.base_rules(d, t)[-1]}
            assert set(after) <= passed and len(after) >= len(passed) - 2
        elif name == "near_duplicates":
            assert set(after) == {c for _, _, c in brute.near_components(list(before.items()))}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute.contaminated(list(before.items()), benchmark) if not r[-1]}
        elif name == "personal_data":
            for d, t in before.items():
                expected, done = "", 0
                for a, _, kind, b in sorted(brute.personal_base(t), key=lambda s: (s[0], -s[3])):
                    if a >= done:
                        expected += t[done:a] + f"[{kind.upper()}]"
                    done = max(done, b)
                assert after[d] == expected + t[done:]
        else:
            from hashlib import sha256

            found = {r.doc_id: r for r in docs.collect()}
            assert {d: r.decoded_sha256 for d, r in found.items()} == {d: sha256(t.encode()).hexdigest() for d, t in before.items()}
            assert all(len(r.ids) == 4 * r.n_tokens and r.n_tokens for r in found.values())
        before = after


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = "import sys, fleetgauge.catalog; assert not any('.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
