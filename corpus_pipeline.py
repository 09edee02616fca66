"""From raw documents to tokens: quality rules, near duplicates, decontamination, personal data, byte pairs.

Each stage reads what the stage before kept, from Parquet. Its decisions take effect on the rows: stages 1 to 3
drop documents (and stage 1 cuts boilerplate lines), stage 4 replaces personal data, stage 5 returns the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.byte_pairs import encode_and_decode
from fleetgauge.llm.common import findable, table, written
from fleetgauge.llm.decontaminate import remove_contaminated
from fleetgauge.llm.line_rules import apply_rules
from fleetgauge.llm.personal import redact
from fleetgauge.llm.similar import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line frequencies keep, without lines above the limit."""
    findable(spark)
    return apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones."""
    findable(spark)
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark stands."""
    findable(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    findable(spark)
    return redact(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text they decode to."""
    import public_tokenizers

    findable(spark)
    found = encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", F.col("ids"), "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_pairs", byte_pairs),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None  # byte pairs, and what bootstrapping finds, are beyond SQL; tests hold the stages against plain versions

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
