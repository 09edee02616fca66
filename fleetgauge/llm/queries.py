"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import personal
from fleetgauge.llm.byte_pairs import encode_and_decode
from fleetgauge.llm.common import findable, table
from fleetgauge.llm.decontaminate import search_benchmark, with_digest
from fleetgauge.llm.difference_cover import remove_repeated_bytes
from fleetgauge.llm.filter_audit import audit_corpus
from fleetgauge.llm.lattice_lm import score_documents
from fleetgauge.llm.line_rules import line_rules
from fleetgauge.llm.sharded_lloyd import cluster_vectors
from fleetgauge.llm.similar import near_duplicates
from fleetgauge.llm.suffix_trees import remove_repeated_words
from fleetgauge.llm.token_files import write_and_read
from fleetgauge.llm.toxicity import judge_toxicity
from fleetgauge.llm.url_trees import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            findable(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Words split by the six ASCII spaces, and their windows. DuckDB's \s has five of them.
SPLIT = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
with words as (select doc_id, {SPLIT.format(text="coalesce(text, '')")} w from documents),
starts as (select doc_id, unnest(generate_series(1, len(w) - 12)) i from words where len(w) >= 13),
windows as (select doc_id, i, md5(array_to_string(w[i:i+12], ' ')) h from starts join words using (doc_id)),
firsts as (select h, min(doc_id) m from windows group by h),
gone as (select distinct doc_id, i + j as i from windows join firsts using (h), (select unnest(generate_series(0, 12)) j) where m < doc_id),
lost as (select doc_id, list(i) g, count(*) n from gone group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed,
  sha256(case when n is null then array_to_string(w, ' ')
    when n = len(w) then '' else (select coalesce(string_agg(x, ' ' order by i), '')
      from (select unnest(w) x, unnest(generate_series(1, len(w))) i) where not list_contains(g, i)) end) kept_sha256
from words left join lost using (doc_id)"""


@query("op2_suffix_tree_dedup", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_words(table(spark, folder, "documents")).drop("kept")


OP6_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
starts as (select doc_id, unnest(generate_series(0, len(h) // 2 - 50)) i from d where len(h) >= 100),
windows as (select doc_id, i, md5(substr(h, 2 * i + 1, 100)) w from starts join d using (doc_id)),
firsts as (select w, min(doc_id) m from windows group by w),
gone as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) > 50 is not false as head
  from windows join firsts using (w) where m < doc_id),
spans as (select doc_id, min(i) a, max(i) + 50 b from
  (select *, sum(head::int) over (partition by doc_id order by i) k from gone) group by doc_id, k),
gaps as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) a, a b from spans
  union all select doc_id, max(b), null from spans group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' order by a) k from gaps join d using (doc_id) group by doc_id),
lost as (select doc_id, sum(b - a) n, count(*) s from spans group by doc_id)
select doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed, cast(coalesce(s, 0) as bigint) n_spans,
  sha256(unhex(coalesce(k, h))) kept_sha256
from d left join lost using (doc_id) left join kept using (doc_id)"""


@query("op6_suffix_array_dedup", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP7_SQL = rf"""
with d as (select doc_id, source host, coalesce(text, '') t, {SPLIT.format(text="coalesce(text, '')")} w from documents),
sized as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
windows as (select doc_id, i, md5(array_to_string(w[i:i+7], ' ')) h
  from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) i from d where len(w) >= 8)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, h) > 1),
repeats as (select doc_id, cast(sum(n) as bigint) n from
  (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) n from twice) group by doc_id),
lines as (select doc_id, host, md5(t) text_hash,
    unnest(list_transform(l, lambda x: lower(trim(regexp_replace(x, '[ \x09-\x0D]+', ' ', 'g'))))) line from sized),
hosts as (select host, count(distinct md5(t)) of_host from d group by host),
above as (select host, line, first_doc from
  (select host, line, count(distinct text_hash) n, min(doc_id) first_doc from lines group by all) join hosts using (host)
  where n > 10 and 1000 * n > 5 * of_host),
chars as (select doc_id, sum(length(line)) line_chars,
    sum(case when first_doc is not null and first_doc <> doc_id then length(line) else 0 end) cut_chars
  from lines left join above using (host, line) group by doc_id),
judged as (select doc_id, cast(len(w) as bigint) n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, coalesce(n, 0) n_repeat_words,
    coalesce(100 * (line_chars - cut_chars) >= 20 * line_chars, true) enough
  from sized left join repeats using (doc_id) left join chars using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and enough kept
from judged"""


@query("op7_line_frequency_rules", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return line_rules(table(spark, folder, "documents")).select(*columns)


@query("op5_url_boosted_trees")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))


OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
sought as (select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') h
  from (select item_id, w, least(10, len(w)) n, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0)),
lengths as (select distinct n from sought),
windows as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') h
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, lengths where len(w) >= n)),
met as (select doc_id, i, n, item_id from windows join sought using (n, h)),
hits as (select doc_id, count(distinct i + j) n_hit from (select doc_id, i, unnest(generate_series(0, n - 1)) j from met) group by doc_id),
named as (select doc_id, count(*) n_items, sha256(string_agg(x, ',' order by x)) s
  from (select distinct doc_id, cast(item_id as varchar) x from met) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (doc_id) left join named using (doc_id)"""


@query("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return with_digest(search_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return judge_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_byte_pairs")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op1_range_coded_tokens")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return write_and_read(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_personal_data")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return personal.with_digest(personal.find_personal(table(spark, folder, "documents")))


OP9_SQL = rf"""
with recursive d as (select doc_id, {SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
sets as (select distinct doc_id, md5(array_to_string(w[i:i+4], ' ')) s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from d where len(w) > 0)),
sizes as (select doc_id, count(*) n from sets group by doc_id),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reached as (select x as doc_id, x as other from both_ways union select r.doc_id, l.y from reached r join both_ways l on l.x = r.other),
least as (select doc_id, min(other) m from reached group by doc_id)
select doc_id, coalesce(n, 0) n_shingles, coalesce(m, doc_id) component_id from d left join sizes using (doc_id) left join least using (doc_id)"""


@query("op9_jaccard_join", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
with recursive d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
said as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by t) m from d),
masks as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    cast(len(w) < 50 as int) + 2 * cast(100 * len(list_distinct(w)) < 65 * len(w) as int)
    + 4 * cast(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > m, false) as int) mask
  from words left join said using (doc_id)),
cells as (select part, mask, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from masks group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) letter, unnest([1, 2, 4, 8, 16]) bit),
orders as (select '' o union all select o || letter from orders, letters where not contains(o, letter)),
steps as (select o, k, l.letter, l.bit, coalesce((select sum(bit) from letters p where contains(substr(o, 1, k - 1), p.letter)), 0)::int applied
  from orders, (select unnest(generate_series(1, 5)) k), letters l where length(o) = 5 and l.letter = substr(o, k, 1)),
counted as (select part, o, k, letter,
    sum(case when mask & (applied | bit) = 0 then n else 0 end) kept,
    sum(case when mask & bit <> 0 and mask & applied = 0 then n else 0 end) removed,
    sum(case when mask & bit <> 0 and mask & applied <> 0 then n else 0 end) redundant,
    sum(case when mask = bit then n else 0 end) unique_fails,
    sum(case when mask & bit <> 0 and mask & applied = 0 then good else 0 end) good_lost,
    sum(case when mask & bit <> 0 and mask & applied = 0 then toxic else 0 end) toxic_lost
  from cells, steps group by all)
select part, o filter_order, cast(k as integer) step, cast(kept as bigint) kept, cast(removed as bigint) removed,
  cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost,
  cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) shapley
from counted"""


@query("op11_filter_interactions", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return audit_corpus(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_subword_lattice")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _lloyd_sql(rounds: int = 10, clusters: int = 8) -> str:
    """Rounds written out, since every one of them aggregates."""
    steps = [
        f"""near{r} as materialized (select v, min_by(c, (d, c)) c, min(d) d from
  (select v, c, cast(sum((x - y) * (x - y)) as bigint) d from cells join c{r} using (i) group by v, c) group by v)"""
        for r in range(rounds + 1)
    ]
    moves = [
        f"""c{r + 1} as materialized (select c, i, coalesce((s - ((s % n) + n) % n) // n, y) y from c{r} left join
  (select c, i, cast(sum(x) as bigint) s, count(*) n from cells join near{r} using (v) group by c, i) using (c, i))"""
        for r in range(rounds)
    ]
    walked = ",\n".join(part for pair in zip(steps, [*moves, ""]) for part in pair if part)
    return f"""
with kept as materialized (select row_number() over () v, vec_id, embedding e from embeddings where len(embedding) = 64
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as materialized (select v, unnest(generate_series(1, 64)) i, cast(floor(1024 * cast(unnest(e) as double)) as bigint) x from kept),
c0 as materialized (select c, i, x y from cells join
  (select v, row_number() over (order by sha256('3:' || vec_id)) - 1 c from kept qualify c < {clusters}) using (v)),
{walked},
digests as (select c, sha256(string_agg(cast(y as varchar), ',' order by i)) s from c{rounds} group by c)
select vec_id, cast(c as integer) "cluster", d distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia,
  cast(sum(d) over () as bigint) inertia, s centroid_sha256
from near{rounds} join kept using (v) join digests using (c)"""


@query("op13_sharded_lloyd", _lloyd_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(table(spark, folder, "embeddings"))
