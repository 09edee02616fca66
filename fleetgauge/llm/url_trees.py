"""URL filter: listed rules first, and boosted trees on lexical features for the rest.

The rules label URLs, and the trees are trained from these labels: a bounded sample of at most ``max_train`` distinct URLs (those
with the least hashes, so it does not depend on file order). A class has half of the sample, or all its URLs if they
are fewer and the other class the rest; weights give either class its share among all distinct labelled URLs.
Features are length, depth, digit ratio, entropy, parameter counts, and the share of blocked rows under the host's suffix and their
number, over all labelled rows. Trees and sample are Spark ML on the JVM; everything else is DataFrame functions.

Defined results: a null url, or one without ``://``, has an empty host and path, so no rule fits and the
trees judge its features like any other's. With labels of one class only, that class is the verdict; without
labels, allow. Repeated rows each get a row; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import small, written

ALPHABET = string.ascii_lowercase + string.digits + "/.-_?=&%:#"
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_blocked", "suffix_seen"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    found = F.instr("url", "://")
    after = F.when(found > 0, F.substring("url", found + 3, F.length("url"))).otherwise(F.lit(""))
    cut = F.regexp_extract("_after", r"^[^/?#]*", 0)
    placed = pages.withColumn("_after", F.coalesce(after, F.lit("")))
    placed = placed.withColumn("host", F.translate(cut, string.ascii_uppercase, string.ascii_lowercase))
    rest = F.substring("_after", F.length("host") + 1, F.length("_after"))
    return placed.withColumn("path", F.regexp_extract(rest, r"^[^?#]*", 0)).drop("_after")


def _first_fit(rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, else null. The rules are a short list, so they are part of the plan."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)
        out = F.when(fits, value(rule)) if out is None else out.when(fits, value(rule))
    return F.lit(None).cast("string") if out is None else out


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


def suffix_of(host: str) -> Column:
    return F.substring_index(host, ".", -1)


def with_features(pages: DataFrame) -> DataFrame:
    """Adds what the trees see of a URL itself, each in time linear in its length."""
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    size = F.greatest(F.length("_url"), F.lit(1)).cast("double")
    counted = pages.withColumn("_url", url)
    counts = [(_count(F.col("_url"), c) / size).alias(f"_{i}") for i, c in enumerate(ALPHABET)]
    counted = counted.select("*", *counts)
    shares = [F.col(f"_{i}") for i in range(len(ALPHABET))]
    entropy = sum((F.when(s > 0, -s * F.log2(s)).otherwise(F.lit(0.0)) for s in shares), F.lit(0.0))
    counted = counted.withColumn("entropy", entropy).drop(*[f"_{i}" for i in range(len(ALPHABET))])
    double = lambda c: c.cast("double")
    return counted.withColumns({
        "length": double(F.length("_url")), "host_length": double(F.length("host")), "path_length": double(F.length("path")),
        "depth": double(_count(F.col("path"), "/")), "labels": double(_count(F.col("host"), ".")),
        "digit_ratio": _count(F.col("_url"), string.digits) / size,
        "parameters": double(F.when(F.instr("_url", "?") > 0, _count(F.col("_url"), "&") + 1).otherwise(F.lit(0))),
        "hyphens": double(_count(F.col("_url"), "-")),
        "suffix": suffix_of("host"),
    }).drop("_url")


def _with_suffix(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    return rows.join(small(suffixes), "suffix", "left").fillna({"suffix_blocked": 0.5, "suffix_seen": 0.0})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """suffix, suffix_blocked, suffix_seen over all rows of (suffix, label)."""
    seen = F.count(F.lit(1)).cast("double")
    return labelled.groupBy("suffix").agg(((F.sum("label") + 1) / (seen + 2)).alias("suffix_blocked"), F.log1p(seen).alias("suffix_seen"))


def training_sample(labelled: DataFrame, max_train: int) -> DataFrame:
    """url, label, weight: at most ``max_train`` distinct URLs of all rows of (url, label)."""
    unique = written(labelled.select("url", "label").distinct(), "labelled-urls")
    of_class = {r["label"]: r["count"] for r in unique.groupBy("label").count().collect()}
    taken = []
    for label, n in sorted(of_class.items()):
        others = sum(of_class.values()) - n
        quota = min(n, max(max_train // 2, max_train - others, 1))
        some = unique.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(quota)
        taken.append(some.withColumn("weight", F.lit(n / quota)))
    sample = unique.limit(0).withColumn("weight", F.lit(0.0))
    for some in taken:
        sample = sample.unionByName(some)
    return sample.coalesce(1)


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_train: int = 20_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    parts = with_parts(pages.select("page_id", "url"))
    ruled = parts.withColumns({"rule": _first_fit(rules, lambda r: r.text), "listed": _first_fit(rules, lambda r: r.verdict)})
    label = (F.col("listed") == "block").cast("double")
    labelled = ruled.where(F.col("listed").isNotNull()).select("url", suffix_of("host").alias("suffix"), label.alias("label"))
    drawn = with_parts(training_sample(labelled, max_train))
    sample = written(with_features(drawn).select("suffix", "label", "weight", *FEATURES[:-2]), "url-sample")
    kinds = [r.label for r in sample.select("label").distinct().orderBy("label").collect()]
    if len(kinds) < 2:
        only = "block" if kinds == [1.0] else "allow"
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit(only)).alias("verdict"))
    suffixes = written(suffix_statistics(labelled), "url-suffixes")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label", weightCol="weight")
    model = learner.fit(assembler.transform(_with_suffix(sample, suffixes)).select("features", "label", "weight"))
    scored = model.transform(assembler.transform(_with_suffix(with_features(ruled), suffixes)))
    method = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"))
