"""Personal data: fixed patterns, and identifiers found by bootstrapping from their contexts.

1. Each text gives its base entities (email, ip, card, phone) and its candidates: tokens of at least 6 characters with a
   digit that no base entity touches. Either has *patterns*: the one, two and three words before it, and those after it.
2. The base entities are the seeds. A pattern is trusted if it stands by ``min_values`` different known values, if they
   are at least ``min_share`` of all seeds and candidates it stands by, and if it stands by them more often than chance has it (at least
   ``min_lift`` times, and significantly for the number of patterns), so words of ordinary text are not trusted, and cues that prose uses too can be.
3. A candidate at trusted patterns becomes known if 1 - Π(1 - share of a pattern) reaches ``min_score``. Then the patterns are
   judged again, until nothing new is found. What is known stays known: shares only grow, and chance is fixed.

Scoring is joins and sums over distinct (pattern, value) pairs; occurrences are only counted. Known identifiers
have the kind ``id`` and never replace a base entity.

Defined results: a null text is empty. Repeated rows each get a row. An empty table gives an empty result. Only doc_id and text
are read; ``redact`` keeps the other columns.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import keyed, sha256_hex, small, with_text, written

KINDS = ("email", "ip", "card", "phone", "id")
# The base patterns. Runs that cannot match from their first character cannot match from a later one.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile("[^\\W\\d_]+|[0-9]+")
_EDGE = "\"'`.,;:!?()[]{}<>"
SHORTEST = 6
PATTERN_WORDS = 3
LONG_WORD = 40  # longer words are all alike in patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in order of start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-40:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


class Patterns:
    """Of spans of one text. The words of the text are found once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in self.at], [b for _, b in self.at]

    def _word(self, i: int) -> str:
        a, b = self.at[i]
        return "0" if self.text[a] in "0123456789" else "*" if b - a > LONG_WORD else self.text[a:b].lower()

    def of(self, start: int, end: int) -> list[str]:
        """'<' and the words before the span, '>' and those after it; a run of digits counts as the word 0."""
        low, high = bisect_right(self.ends, start), bisect_left(self.starts, end)
        left = [self._word(i) for i in range(max(0, low - PATTERN_WORDS), low)]
        right = [self._word(i) for i in range(high, min(len(self.at), high + PATTERN_WORDS))]
        return ["<" + " ".join(left[-n:]) for n in range(1, len(left) + 1)] + [">" + " ".join(right[:n]) for n in range(1, len(right) + 1)]


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    out, done, i = [], 0, 0
    found = _DIGIT.search(text)
    while found:
        right = _SPACE.search(text, found.end())
        end = right.start() if right else len(text)
        start = max(text.rfind(c, done, found.start()) for c in " \t\n\v\f\r") + 1
        start = max(start, done)
        inner = max(text.rfind(c, start, found.start()) for c in "=:") + 1  # the value of name=value
        low, high = max(start, inner), end
        while low < high and text[low] in _EDGE:
            low += 1
        while high > low and text[high - 1] in _EDGE:
            high -= 1
        while i < len(taken) and taken[i][2] <= low:
            i += 1
        j, free = i, True
        while free and j < len(taken) and taken[j][0] < high:
            free = taken[j][2] <= low
            j += 1
        if high - low >= SHORTEST and free:
            out.append((low, high))
        done = end
        found = _DIGIT.search(text, end)
    return out


SPAN = "start: int, kind: string, end: int, value: string, patterns: array<string>"
FOUND = f"doc_id long, text_hash long, spans array<struct<{SPAN}>>, candidates array<struct<{SPAN}>>, base_sha256 string"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _as_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def read_entities(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                spans, others, digests = [], [], []
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    open_spans = candidates(text, base)
                    patterns = Patterns(text if base or open_spans else "")
                    describe = lambda a, k, b, t=text, p=patterns: {"start": a, "kind": k, "end": b, "value": t[a:b], "patterns": p.of(a, b)}
                    spans.append([describe(*s) for s in base])
                    others.append([describe(a, "id", b) for a, b in open_spans])
                    digests.append(sha256_hex(_as_text(base).encode()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(spans, _ARROW), pa.array(others, _ARROW), pa.array(digests)],
                    names=["doc_id", "text_hash", "spans", "candidates", "base_sha256"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")).mapInArrow(run, FOUND)


def _small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """For a join: sent to all tasks if it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _phrases(words: Column) -> Column:
    """Hashes of all runs of one to three words."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    rest = lambda x, step: F.slice(x, F.lit(step + 1), F.greatest(F.size(x) - step, F.lit(0)))
    run = lambda x, step: F.filter(F.zip_with(x, rest(one, step), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), lambda h: h.isNotNull())
    two = run(one, 1)
    return F.concat(one, two, run(two, 2))


def pattern_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern stand in the corpus."""
    hashed = patterns.select("pattern", F.element_at(_phrases(F.split(F.expr("substring(pattern, 2)"), " ")), -1).alias("phrase"))
    hashed = written(hashed, "pattern-phrases")
    parted = F.split(F.regexp_replace(F.lower(F.col("text").cast("string")), "[0-9]+", " 0 "), r"[^\p{L}0]+")
    words = F.transform(F.filter(parted, lambda w: w != ""), lambda w: F.when(F.length(w) > LONG_WORD, F.lit("*")).otherwise(w))
    found = docs.select(words.alias("words")).select(F.explode(_phrases(F.col("words"))).alias("phrase"))
    counted = found.join(_small(hashed.select("phrase").distinct()), "phrase").groupBy("phrase").agg(F.count(F.lit(1)).alias("total"))
    return hashed.join(counted, "phrase", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def discover(
    docs: DataFrame, entities: DataFrame, min_values: int = 3, min_share: float = 0.5, min_score: float = 0.5, min_lift: float = 4.0
) -> DataFrame:
    """(value): candidates that trusted patterns make known."""
    spans = lambda column, seed: entities.select(F.explode(column).alias("s")).select(
        F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.lit(seed).alias("seed")
    )
    pairs = spans("spans", True).unionByName(spans("candidates", False)).groupBy("pattern", "value", "seed").agg(F.count(F.lit(1)).alias("n"))
    edges = written(pairs, "pattern-value-pairs")
    # a pattern can only ever matter if a candidate stands by it
    judged = edges.groupBy("pattern").agg(F.countDistinct("value").alias("values"), F.sum("n").alias("all_n"), F.bool_and("seed").alias("closed"))
    patterns = written(judged.where((F.col("values") >= min_values) & ~F.col("closed")).select("pattern", "all_n"), "patterns")
    known = edges.where("false").select("value")
    tested = patterns.count()
    if not tested or not edges.where("seed").limit(1).count():
        return known
    text = F.col("text").cast("string")
    words = docs.agg(F.sum(F.length(text) - F.length(F.translate(text, " \t\n\r", "")) + 1)).first()[0]
    n_entities = entities.agg(F.sum(F.size("spans") + F.size("candidates"))).first()[0]
    expected = F.greatest(F.col("total"), F.col("all_n")) * F.lit(n_entities / max(words, n_entities))
    totals = written(
        patterns.join(pattern_totals(docs, patterns), "pattern").select("pattern", "all_n", expected.alias("expected")), "pattern-totals"
    )
    # the logarithm of the chance of so many or more is at most -(n ln(n / expected) - n + expected)
    n = F.col("known_n")
    surprise = n * F.log(n / F.col("expected")) - n + F.col("expected")
    specific = (n >= min_lift * F.col("expected")) & (surprise >= math.log(100 * tested))
    open_edges = written(edges.join(_small(patterns.select("pattern")), "pattern"), "open-pairs")
    before = 0
    while True:  # every round but the last finds a value
        marked = open_edges.join(_small(known.withColumn("found", F.lit(True))), "value", "left")
        judged = marked.where(F.col("seed") | F.col("found")).groupBy("pattern").agg(F.sum("n").alias("known_n"), F.countDistinct("value").alias("known_values"))
        share = n / F.col("all_n")
        trusted = judged.join(totals, "pattern").where((F.col("known_values") >= min_values) & (share >= min_share) & specific)
        trusted = written(trusted.select("pattern", F.least(share, F.lit(0.999)).alias("share")), "trusted-patterns")
        scored = open_edges.where("not seed").join(_small(trusted), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("score"))
        known = written(scored.where(F.col("score") >= min_score - 1e-9).select("value"), "known-values")
        now = known.count()
        if now == before:
            return known
        before = now


def find_personal(docs: DataFrame, **limits) -> DataFrame:
    """A row for each document: doc_id, text_hash, its base spans, found (spans of discovered identifiers), base_sha256."""
    entities = written(read_entities(docs).withColumn("row", F.monotonically_increasing_id()), "entities")
    known = discover(docs, entities, **limits).distinct()
    met = entities.select("row", F.inline("candidates")).join(_small(known), "value")
    found = met.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    return entities.drop("candidates").join(found, "row", "left").drop("row")


def with_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base entities, base_sha256 and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    placed = lambda s: F.struct(s["start"].alias("start"), order(s).alias("at"), s["kind"].alias("kind"), s["end"].alias("end"))
    base, more = F.transform("spans", placed), F.transform(F.coalesce("found", F.expr("array()").cast("array<struct<start: int, kind: string, end: int>>")), placed)
    text = F.transform(F.array_sort(F.concat(base, more)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *[count(k) for k in KINDS[:-1]], "base_sha256", F.array_join(text, ",").alias("spans"))


def redact(docs: DataFrame, **limits) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one."""
    found = find_personal(docs, **limits)
    spans = F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.coalesce("found", F.expr("array()").cast("array<struct<start: int, kind: string, end: int>>")),
    )
    hits = found.select("doc_id", "text_hash", spans.alias("cut")).where(F.size("cut") > 0)
    hits = hits.groupBy("doc_id", "text_hash").agg(F.first("cut").alias("cut"))
    hits = small(written(hits.withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"}), "spans-to-redact"))

    # positions in a long text cost a walk each in substring(), so a text is cut here in one go
    @F.udf("string", useArrow=True)
    def replaced(text: str, cut: list) -> str:
        out, done = [], 0
        for s in sorted(cut or [], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= done:
                out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
            done = max(done, s["end"])
        return "".join(out) + text[done:]

    joined = keyed(docs).join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    untouched = joined.where(F.col("cut").isNull()).select("document.*")
    touched = joined.where(F.col("cut").isNotNull()).withColumn("clean", replaced("document.text", "cut"))
    return untouched.unionByName(touched.select(with_text(docs, F.col("clean")).alias("document")).select("document.*"))
