import pytest

import brute
from corpora import awkward
from fleetgauge.llm import decontaminate, personal
from fleetgauge.llm.decontaminate import remove_contaminated, search_benchmark, with_digest
from fleetgauge.llm.line_rules import Limits, apply_rules, line_rules
from fleetgauge.llm.toxicity import fit, judge_toxicity, score_documents
from fleetgauge.llm.url_trees import Rule, judge_urls, suffix_statistics, training_sample

# --- lines ---------------------------------------------------------------------------


def test_base_metrics_equal_brute_force(documents):
    rows = [*awkward(), (910, "a b c d e f g h\na b c d e f g h\n\n a b c d e f g h"), (911, "#tag <b> $5 | & 10% *\n#tag <b> $5 | & 10% *")]
    found = line_rules(documents(rows)).collect()
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert {tuple(r[n] for n in names) for r in found} == {brute.base_rules(d, t) for d, t in rows}


def test_boilerplate_is_cut_but_from_the_first_document(documents):
    filler = lambda i: " ".join(f"u{i}x{j}" for j in range(30))
    notice, menu = "All  rights reserved by nobody in particular at all", "Home About Contact"
    rows = [(i, f"{filler(i)}\n{notice}") for i in range(20)] + [(100 + i, f"{menu}{' ' * i}\n{notice.upper()}") for i in range(12)]
    rows += [(200, filler(1)), (None, f"{filler(9)} z\n{notice}")]
    limits = Limits(min_words=3, min_docs=10, max_per_mille=100)
    df = documents(rows, source=lambda i: "one")
    found = {r.doc_id: r for r in line_rules(df, limits).collect()}
    assert found[0].cut_lines is None and len(found[1].cut_lines) == 1 and found[1].kept and not found[105].kept
    kept = {r.doc_id: r.text for r in apply_rules(df, limits).collect()}
    assert kept[0] == rows[0][1] and kept[1] == filler(1) and kept[200] == filler(1) and kept[None] == f"{filler(9)} z" and 105 not in kept
    assert apply_rules(df, limits).columns == df.columns
    assert line_rules(df.where("false")).count() == 0


def test_repeated_rows_and_copies(documents):
    text = "\n".join(" ".join(f"c{i}w{j}" for j in range(12)) for i in range(4))
    rows = [(1, text), (1, text), *[(10 + i, text) for i in range(40)], (None, None), (None, None)]
    found = line_rules(documents(rows, source=lambda i: None)).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 42  # copies are one text


def test_copies_do_not_hide_lines_of_other_documents(documents):
    filler = lambda i: " ".join(f"u{i}x{j}" for j in range(30))
    rows = [(i, f"{filler(i)}\nsubscribe to our letter today") for i in range(12)] + [(100 + i, filler(99)) for i in range(300)]
    limits = Limits(max_per_mille=500)  # 12 of 13 distinct documents, of 312 with copies
    found = {r.doc_id: r for r in line_rules(documents(rows, source=lambda i: "one"), limits).collect()}
    assert found[0].cut_lines is None and all(len(found[i].cut_lines) == 1 and found[i].kept for i in range(1, 12))
    assert all(r.cut_lines is None and r.kept for d, r in found.items() if d >= 100)


# --- benchmark --------------------------------------------------------------------------


@pytest.mark.parametrize("slice_bytes,shard", [(1 << 20, 400_000), (300, 400_000), (1 << 20, 25)])
def test_decontamination_equals_brute_force(spark, documents, monkeypatch, slice_bytes, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    rows = awkward()
    texts = dict(rows)
    items = [
        (1, " ".join((texts[1] or "").split()[20:45])), (10, "One two"), (2, "ONE"), (3, None), (4, ""), (5, " ".join((texts[1] or "").split()[25:36])),
        (6, "no such words anywhere in any of the documents here ok"), (None, "one; two!"), (7, " ".join((texts[3] or "").split()[3:12])),
    ]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    if shard == 400_000:
        found = {tuple(r) for r in with_digest(search_benchmark(documents(rows), benchmark, slice_bytes=slice_bytes)).collect()}
        assert found == brute.contaminated(rows, items)
    else:
        from fleetgauge.llm.decontaminate import Items, _search_group, words_of

        names = [(None if i is None else str(i), t) for i, t in items]
        words = [words_of(t) for _, t in rows]
        hit, matches = _search_group(words, Items.of(names, 10), 10)
        expected, low = {r[0]: r for r in brute.contaminated(rows, items)}, 0
        for d, (doc, _) in enumerate(rows):
            assert (int(hit[low : low + len(words[d])].sum()), len(matches.get(d, []))) == expected[doc][2:4]
            low += len(words[d])


def test_longest_match_and_removal(spark, documents):
    item = [f"q{i}" for i in range(25)]
    rows = [(1, " ".join(["a", "b", *item[3:20], "c"])), (2, "clean words"), (2, "clean words"), (3, None), (None, " ".join(item))]
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r.matches for r in search_benchmark(documents(rows), benchmark).collect()}
    assert [(m.item_id, m.words, m["at"]) for m in found[1]] == [("5", 17, 2)] and [m.words for m in found[None]] == [25]
    df = documents(rows)
    kept = remove_contaminated(df, benchmark)
    assert sorted((r.doc_id for r in kept.collect())) == [2, 2, 3] and kept.columns == df.columns
    assert remove_contaminated(df, benchmark.where("false")).count() == 5 and search_benchmark(df.where("false"), benchmark).count() == 0


# --- personal data -------------------------------------------------------------------------

PARTS = ["a", "b@", "@", ".", "1", "22", "333", "+1 (", "555", "-", " ", "4111 1111 1111 1111", "255.", "10.0.0.1", "\n", "é", "x@y.com", ")", "0000", "%"]


def test_base_spans_equal_the_patterns():
    import random

    pick = random.Random(3)
    for _ in range(6000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randrange(0, 25)))
        assert personal.base_spans(text) == [(a, k, b) for a, _, k, b in brute.personal_base(text)], text


@pytest.mark.parametrize("unit", ["1", "a", "@", "a@", "1.", "+1", "1 ", "1-"])
def test_long_runs_take_linear_time(unit):
    text = unit * (200_000 // len(unit))
    personal.candidates(text, personal.base_spans(text))


def test_identifiers_are_discovered_from_contexts(documents):
    rows = [(i, f"Some words here. customer reference: AB-{1000 + i}-X9 and mail") for i in range(30)]
    rows += [(100 + i, f"the reference: +1 (212) 555-0{100 + i} fine") for i in range(60)]
    rows += [(500 + i, "plain 1234567 text") for i in range(10)] + [(900, None), (901, ""), (None, "x@y.org"), (902, "a@b.co a@b.co"), (902, "a@b.co a@b.co")]
    df = documents(rows)
    found = {r.doc_id: r.spans for r in personal.with_digest(personal.find_personal(df)).collect()}
    assert found[0] == "id:37:47" and found[500] == "" and found[100] == "phone:15:32" and found[900] == "" and found[None] == "email:0:7"
    clean = personal.redact(df)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.count() == len(rows) and clean.columns == df.columns
    assert texts[0] == "Some words here. customer reference: [ID] and mail" and texts[902] == "[EMAIL] [EMAIL]" and texts[500] == "plain 1234567 text"
    assert personal.redact(df.where("false")).count() == 0


def test_identifiers_of_any_shape_are_found_by_phrases_on_either_side_round_after_round(documents):
    prose = "the reference was made in a long letter and nobody could call me about it " * 4
    rows = [(i, f"{prose}. please call me at +1 (212) 555-0{100 + i} today") for i in range(20)]
    rows += [(100 + i, f"{prose}. please call me at AB-{10 + i}-CD-34 soon") for i in range(10)]  # words that prose has too
    rows += [(200 + i, f"{prose}. 12-{10 + i}-56-78 is my badge") for i in range(10)] + [(300 + i, f"{prose}. x{i}@mail.org is my badge") for i in range(20)]
    chain = ["ticket", "folder", "dossier", "ledger", "parcel", "voucher"]
    value = lambda k, i: f"K{k}-{20 + i}-Z{i}"
    rows += [(400 + i, f"{prose}. {chain[0]} y{i}@mail.org") for i in range(9)]
    for k, cue in enumerate(chain):  # each cue is made known by values of the one before it
        rows += [(1000 + 100 * k + i, f"{prose}. {cue} {value(k, i)}") for i in range(4)]
        rows += [(1050 + 100 * k + i, f"{prose}. {cue} {value(k - 1, i)}") for i in range(4) if k]
    rows += [(5000 + i, f"{prose}. nothing 77-{10 + i}-99 here") for i in range(9)]
    found = {r.doc_id: r.spans for r in personal.with_digest(personal.find_personal(documents(rows))).collect()}
    low = len(prose) + 2
    assert found[103] == f"id:{low + 18}:{low + 29}" and found[203] == f"id:{low}:{low + 11}"
    assert found[1503] == f"id:{low + 8}:{low + 16}" and found[5003] == ""


# --- toxicity ---------------------------------------------------------------------------------


def test_toxic_words_are_learned_from_labels(spark, documents):
    import random

    pick = random.Random(8)
    plain = ["river", "stone", "meadow", "lantern", "harbor", "copper", "violet", "quiet"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [pick.choice(plain) for _ in range(30)] + ([pick.choice(["grumblewort", "snarkfang"])] if toxic else [])
        pick.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), "extra"))
    rows += [(None, None), (1000, "")]
    labels += [(1, None, "x"), (None, 1, "x"), (5000, 1, "x")]
    label_df = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    df = documents(rows)
    found = judge_toxicity(df, label_df).collect()
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    joined = fit(df, label_df, small=0)  # the way for labels that are too many to send
    assert {r.predicted for r in score_documents(df, joined).where("doc_id = 4").collect()} == {1}
    assert {r.score < 0.01 for r in judge_toxicity(df, label_df.where("false")).collect()} == {True}
    assert judge_toxicity(df.where("false"), label_df).count() == 0


# --- urls ---------------------------------------------------------------------------------------


def test_rules_and_parts_of_urls(spark):
    urls = [
        "https://a.com/x", "http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://x.www.example.com/en/", "https://a.net/es/1?q=/fr/", "//none",
        None, "http://a.com", "http://a.com?x=/y", "http://notexample.com/en/", "ftp://b.org/p#f", "http://a.net/fr", "", "http://a.net/en/?a=1&b=2#c",
    ]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    found = sorted(judge_urls(pages).collect(), key=lambda r: r.page_id)
    assert len(found) == 2 * len(urls)
    assert [(r.host, r.path, r.rule) for r in found[: len(urls)]] == [brute.url_parts(u) for u in urls]
    listed = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    assert all(r.verdict == listed.get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in found)
    assert {r.verdict for r in judge_urls(pages.where("url like '%a.com/x' or url is null")).collect()} == {"allow"}
    assert judge_urls(pages.where("false")).count() == 0


def test_url_sample_holds_distinct_urls_of_both_classes(spark):
    urls = ["https://hot.com/x"] * 300 + [f"https://a{i}.com/p{i}" for i in range(300)] + [f"http://a{i}.net/es/{i}" for i in range(3)]
    urls += [f"http://b{i}.net/de/{i}" for i in range(20)] + [f"http://b{i}.org/de/{i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r.verdict for r in judge_urls(pages, max_train=40).collect()}
    assert {found[i] for i in range(603, 623)} == {"block"}  # the suffix of the few blocked rows
    labelled = pages.where("page_id < 603").selectExpr("url", "'com' suffix", "cast(url like '%.net/%' as double) label")
    sample = training_sample(labelled, 40).collect()
    assert len({r.url for r in sample}) == len(sample) == 40 and sum(r.label for r in sample) == 3
    assert {(r.label, round(r.weight * (3 if r.label else 37))) for r in sample} == {(1.0, 3), (0.0, 301)}
    stats = suffix_statistics(labelled).collect()[0]
    assert stats.suffix_blocked == 4 / 605 and round(stats.suffix_seen, 6) == 6.403574  # log(604)


def test_url_suffixes_count_rows_outside_the_sample(spark):
    urls = [f"https://a{i}.com/en/{i}" for i in range(400)] + [f"http://a{i}.net/es/{i}" for i in range(400)] + ["http://a.xyz/es/1", "http://b.xyz/de/1"]
    rules = (Rule("allow", "com", "/"), Rule("block", "net", "/es/"), Rule("block", "xyz", "/es/"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    ruled = judge_urls(pages, rules, max_train=10)
    assert ruled.where("page_id = 801").first().verdict == "block"
