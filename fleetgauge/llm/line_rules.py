"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, single spaces), hashed and counted: on how many distinct documents of
their host does a line stand? ``source`` is the host of a document. A line above the limit is boilerplate and is
removed, except from the document that has it with the least doc_id. A document of which too little
is left is rejected, as is one that fails the base rules.

The limit is the larger of ``min_docs`` and ``max_per_mille`` of the host's documents. Documents with one text count
as one document on either side of it: a group of copies neither makes its own lines boilerplate nor hides those of others.

Defined results: a null or empty text has no words and fails the base rules. A null host is a host of its own.
Rows with one doc_id and one text get one verdict each; a null doc_id is never the first to have a line.
An empty table gives an empty result. Other columns pass through ``apply_rules`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import keyed, small, with_text, written

SPACES = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    min_docs: int = 10
    max_per_mille: int = 5
    min_left_percent: int = 20


def _normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def _doubled(hashes: Column, step: int) -> Column:
    """Hashes of windows twice as wide, from hashes of windows of ``step`` words."""
    left = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), left), F.slice(hashes, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, line hashes with their characters, and the metrics of the text alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: F.regexp_replace(line, SPACES, "") != ""
    split = docs.select(
        "doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("text_hash"),
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), has_word).alias("lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    sized = split.select(
        "doc_id", "host", "text_hash", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        _sum(F.transform("words", lambda w: F.length(w).cast("long"))).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", _normalised).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("one"),
    )
    counted = sized.withColumn("lines", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars"))))
    doubled = counted.withColumn("two", _doubled(F.col("one"), 1)).drop("one")
    doubled = doubled.withColumn("four", _doubled(F.col("two"), 2)).drop("two")
    doubled = doubled.withColumn("eight", _doubled(F.col("four"), 4)).drop("four")
    repeats = F.size(F.array_distinct("eight")) < F.size("eight")
    ordered = doubled.withColumn(
        "placed", F.when(repeats, F.sort_array(F.transform("eight", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    ).drop("eight")
    same = lambda e, at: F.coalesce(F.get(F.col("placed"), at)["x"] == e["x"], F.lit(False))
    found = ordered.withColumn(
        "at", F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(
            F.filter("placed", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]
        )))
    ).drop("placed")
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    return found.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), _sum(gaps)).otherwise(F.lit(0).cast("long"))).drop("at")


def line_counts(metrics: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, first_doc) of the lines above the limit."""
    lines = metrics.select("host", "text_hash", "doc_id", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.countDistinct("text_hash").alias("docs"), F.min("doc_id").alias("first_doc"))
    counted = counted.where(F.col("docs") > limits.min_docs)
    hosts = metrics.groupBy("host").agg(F.countDistinct("text_hash").alias("of_host")).withColumnRenamed("host", "its_host")
    joined = counted.join(hosts, F.col("host").eqNullSafe(F.col("its_host")))
    return joined.where(1000 * F.col("docs") > limits.max_per_mille * F.col("of_host")).select("host", "line", "first_doc")


def line_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """A row for each document: the metrics, base_failed, cut_lines (hashes of lines to remove), left_chars, kept."""
    # the number of a row is fixed once the rows are written
    metrics = written(base_metrics(docs).withColumn("row", F.monotonically_increasing_id()), "line-metrics")
    above = written(line_counts(metrics, limits), "frequent-lines").withColumnsRenamed({"host": "its_host", "line": "its_line"})
    lines = metrics.select("row", "doc_id", "host", F.inline("lines"))
    met = lines.join(above, (F.col("line") == F.col("its_line")) & F.col("host").eqNullSafe(F.col("its_host")))
    cut = met.where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy("row").agg(
        F.sum("chars").alias("cut_chars"), F.collect_set("line").alias("cut_lines")
    )
    whole = metrics.withColumn("line_chars", _sum(F.transform("lines", lambda x: x["chars"].cast("long")))).drop("lines")
    left = F.col("line_chars") - F.coalesce("cut_chars", F.lit(0))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    judged = whole.join(cut, "row", "left").withColumn("base_failed", failed).withColumn("left_chars", left)
    return judged.withColumn("kept", ~failed & (100 * left >= limits.min_left_percent * F.col("line_chars"))).drop("row", "cut_chars")


def apply_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The documents that stay, with their own columns; lines above the limit are cut from the text."""
    rules = line_rules(docs, limits).where(~F.col("kept") | F.col("cut_lines").isNotNull())  # most documents stay as they are
    rules = rules.groupBy("doc_id", "text_hash", "host").agg(F.min("kept").alias("kept"), F.first("cut_lines").alias("cut_lines"))
    rules = small(written(rules, "line-verdicts"))
    rows = keyed(docs)
    same = rows["document.doc_id"].eqNullSafe(rules["doc_id"]) & (rows["text_hash"] == rules["text_hash"]) & rows["document.source"].eqNullSafe(rules["host"])
    joined = rows.join(rules, same, "left").where(F.coalesce("kept", F.lit(True)))
    text = F.col("document.text")
    stays = lambda line: ~F.array_contains("cut_lines", F.xxhash64(_normalised(line)))
    text = F.when(F.size("cut_lines") > 0, F.array_join(F.filter(F.split(text, "\n"), stays), "\n")).otherwise(text)
    return joined.select(with_text(docs, text).alias("document")).select("document.*")
