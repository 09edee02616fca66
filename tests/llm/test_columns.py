"""Stages of the pipeline keep the columns of their documents, whatever these are called."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm.common import small
from fleetgauge.llm.decontaminate import remove_contaminated
from fleetgauge.llm.line_rules import Limits, apply_rules
from fleetgauge.llm.personal import redact
from fleetgauge.llm.similar import keep_first

NAMES = (
    "_id _hash _text_hash _key _d _t _h _kept _cut _spans _bad document id text_hash kept cut cut_lines clean host bad row row_hash "
    "first_id first_hash other_id other_hash hit_id hit_hash spans found candidates class_node component_node node digest line lines"
).split()
WORDS = " ".join(f"w{i}" for i in range(30))
ROWS = [(1, f"{WORDS} a@b.org"), (2, f"{WORDS} a@b.org"), (3, None), (4, " ".join(f"v{i}" for i in range(25))), (None, "lone words " * 3)]


@pytest.fixture
def clashing(spark):
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, source string, n_chars int")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in NAMES], F.lit(1.5).alias("a.b `c`"))


def stages(spark):
    items = spark.createDataFrame([("i", " ".join(f"v{i}" for i in range(12)))], "item_id string, text string")
    return {
        "rules": (lambda d: apply_rules(d, Limits(max_repeat_percent=100)), {1, 2, 4}),
        "similar": (keep_first, {1, 3, 4, None}),
        "benchmark": (lambda d: remove_contaminated(d, items), {1, 2, 3, None}),
        "personal": (redact, {1, 2, 3, 4, None}),
    }


@pytest.mark.parametrize("name", ["rules", "similar", "benchmark", "personal"])
def test_columns_with_clashing_names_come_through(spark, clashing, name):
    stage, stay = stages(spark)[name]
    found = stage(clashing)
    assert found.columns == clashing.columns and [f.dataType for f in found.schema] == [f.dataType for f in clashing.schema]
    before, after = ({r.doc_id: r.asDict() for r in df.collect()} for df in (clashing, found))
    assert set(after) == stay
    for doc, row in after.items():
        if name == "personal" and doc in (1, 2):
            assert row["text"] == f"{WORDS} [EMAIL]" and row["n_chars"] == len(row["text"])
            row = {**row, "text": before[doc]["text"], "n_chars": before[doc]["n_chars"]}
        assert row == before[doc]
    assert stage(clashing.where("false")).count() == 0


def test_rows_with_one_id_and_text_are_one_document(spark):
    docs = spark.createDataFrame([(1, WORDS, "x"), (1, WORDS, "y"), (2, "other", "z")], "doc_id long, text string, _id string")
    assert sorted(r.doc_id for r in keep_first(docs).collect()) == [1, 2]


def test_only_few_bytes_are_sent_to_all_tasks(spark):
    docs = spark.range(100).select("id", F.expr("sequence(1, 1000)").alias("many"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(docs)) and hinted(small(docs.select("id"), size=10_000)) and not hinted(small(docs, size=10_000))
