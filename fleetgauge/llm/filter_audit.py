"""How filters interact: every order of them, step by step, from the counts of their combined failures.

Each document becomes a mask of the filters that it fails, and the corpus becomes cells: documents by part and mask.
A recursive CTE walks all orders: a row of it is a prefix of an order, the bits applied so far and a mask, and a level
of the recursion extends every prefix by each letter it lacks. The row says what that step does to the documents of
the mask. The walk starts from the masks that occur, so it has at most 2^n masks times the prefixes of n letters
whatever the corpus is, and meets the cells of the parts in one join.

The corpus is read once, for masks; only (doc_id, part, mask, digest of the text) is shuffled. Copies of one text are
counted per (text, part, labels) before they meet, so a text that a third of all documents share is a few rows.

Defined results: a null text is empty, a null part is the empty string. A row without doc_id is no copy and makes no
copies, and has no labels. Rows with one doc_id each count; they are not copies of one another, but of smaller ones. A document
whose label rows disagree is good if one says so, and toxic if one says so. Documents without label rows are
neither. An empty table gives no rows. Only doc_id, text and source, and doc_id, quality and toxic are read; other columns
do not matter. Texts are told apart by MD5.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.common import written

MAX_FILTERS = 6  # 2^6 masks times 1,956 prefixes; the recursion of Spark stops at a million rows
# The filters of the audit, by letter. E compares texts across the table and is judged apart.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
COPIES = "E"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides, by letter."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None) -> DataFrame:
    """(part, mask, documents, good, toxic): bit i of the mask is the i-th letter, the last bit is a copy of a smaller doc_id's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    conditions = text_conditions(text) if conditions is None else conditions
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(conditions.values())]
    copy_bit = 1 << len(bits)
    judged = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        sum(bits, F.lit(0)).alias("mask"),
    )
    said = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    )
    labelled = judged.join(said, "doc_id", "left").withColumns(
        {name: F.coalesce(F.col(name), F.lit(False)) for name in ("good", "toxic")}
    )
    # Copies: counts by doc_id, then the least doc_id of each (text, part, labels), then of each text.
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_doc = labelled.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    by_kind = by_doc.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nameless"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = by_kind.withColumn("first", first).select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask").alias("mask"), originals.alias("n")),
                F.struct(F.col("mask").bitwiseOR(copy_bit).alias("mask"), (F.col("n") - originals).alias("n")),
            )
        ).alias("c"),
    )
    return (
        split.where("c.n > 0")
        .groupBy("part", F.col("c.mask").alias("mask"))
        .agg(
            F.sum("c.n").alias("documents"),
            F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"),
        )
    )


WALK = """
with recursive walk(prefix, step, letter, bit, applied, mask) as (
  select cast('' as string), 0, cast('' as string), 0, 0, mask from {masks}
  union all
  select concat(w.prefix, w.next.letter), w.step + 1, w.next.letter, w.next.bit, w.applied | w.bit, w.mask
  from (
    select *, explode(filter(array(LETTERS), x -> (applied | bit) & x.bit = 0)) as next from walk where step < COUNT
  ) w
)
select prefix, step, letter, mask,
  mask & (applied | bit) = 0 as kept,
  mask & bit <> 0 and mask & applied = 0 as removed,
  mask & bit <> 0 and mask & applied <> 0 as redundant,
  mask = bit as alone
from walk where step > 0
"""


def walk_orders(masks: DataFrame, letters: str) -> DataFrame:
    """A row for each prefix of each order and each mask: what the last step of the prefix does to that mask."""
    if not 1 <= len(letters) <= MAX_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"1 to {MAX_FILTERS} different letters, not {letters!r}")
    listed = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    return masks.sparkSession.sql(WALK.replace("LETTERS", listed).replace("COUNT", str(len(letters))), masks=masks)


def audit_filters(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of all letters and step; see the columns below.

    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    cells = written(cells, "cells")
    walk = written(walk_orders(cells.select("mask").distinct(), letters), "orders")
    # Bounded by the letters: at most 2^n masks times the prefixes.
    met = cells.join(F.broadcast(walk), "mask")

    def count(state: str, of: str = "documents") -> Column:
        return F.sum(F.when(F.col(state), F.col(of)).otherwise(0)).cast("long")

    by_prefix = met.groupBy("part", "prefix", "letter", "step").agg(
        count("kept").alias("kept"), count("removed").alias("removed"), count("redundant").alias("redundant"),
        count("alone").alias("unique_fails"), count("removed", "good").alias("good_lost"), count("removed", "toxic").alias("toxic_lost"),
    )
    # A prefix begins as many orders as the letters that it lacks can be arranged in.
    weighted = F.sum(F.col("removed") * F.factorial(F.lit(len(letters)) - F.col("step"))).over(Window.partitionBy("part", "letter"))
    orders = walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    prefixes = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).select(
        "filter_order", F.substring("filter_order", F.lit(1), F.col("step")).alias("prefix")
    )
    return (
        by_prefix.withColumn("shapley", weighted.cast("long"))
        .join(F.broadcast(prefixes), "prefix")
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
        )
    )


def audit_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E."""
    letters = "".join(text_conditions(F.lit(""))) + COPIES
    return audit_filters(failure_cells(docs, labels), letters)
