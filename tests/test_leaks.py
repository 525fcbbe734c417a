import random

import numpy as np
from pyspark.sql import functions as F

from veilspan.operators import carryover, containment, detect, dictionary, facts, fingerprint, sieve, winnow

FACTS = [
    ("a", 0, "names", 0, "Lena Voss"), ("a", 0, "orgs", 0, "Voss Mills LLC"), ("a", 0, "amounts", 0, "$90,000"),
    ("b", 1, "names", 0, "Omar Pruett"), ("b", 1, "amounts", 0, "$418,000"), ("b", 1, "names", 1, "Lena Voss"), ("b", 1, "amounts", 1, "$90,000"),
    ("c", 2, "names", 0, "Omar Pruett"), ("c", 2, "names", 1, "Park"),
]
FACT_DDL = "matter_id string, matter_ord int, category string, ord int, value string"


def hits(spark, text, matter="a"):
    drafts = spark.createDataFrame([(1, matter, text)], "draft_id int, matter_id string, text string")
    rows = fingerprint.fingerprint_hits(drafts, spark.createDataFrame(FACTS, FACT_DDL)).orderBy("start").collect()
    return [(r["owner"], r["evidence"]) for r in rows]


def test_foreign_names_ignore_case_and_go_to_the_first_owner(spark):
    assert hits(spark, "we saw OMAR PRUETT there") == [("b", "OMAR PRUETT")]


def test_own_facts_are_subtracted_even_when_shared(spark):
    assert hits(spark, "Lena Voss agreed to $90,000 for Voss Mills LLC") == []


def test_substring_match_has_no_word_boundary(spark):
    assert hits(spark, "the parking lot") == [("c", "park")]


def test_amount_forms(spark):
    for said in ("$418,000", "$418K", "$418 k", "418 thousand dollars", "418000"):
        assert hits(spark, f"about {said} paid") == [("b", said)], said
    assert hits(spark, "about $418,250 paid") == []
    assert hits(spark, "about $418,000.50 paid") == [("b", "$418,000.50")]


def brute(texts, needles, fold):
    out = set()
    for k, text in texts:
        for n in needles:
            t, v = (text.lower(), n.lower()) if fold else (text, n)
            i = t.find(v)
            while i >= 0:
                out.add((k, n, i))
                i = t.find(v, i + 1)
    return out


def test_literal_matches_equal_brute_force(spark):
    rng = random.Random(7)
    pieces = ["ab", "abc", "b", "", "Ba", "cab", "a\nb", "é", "abcabcabc"]
    texts = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    needles = sorted({" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(40)} - {""})
    t = spark.createDataFrame(texts, "k int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "value string")
    for fold in (False, True):
        unique = n if not fold else n.groupBy(F.lower("value").alias("value")).agg(F.lit(1).alias("one")).select("value")
        got = {(r["k"], r["value"], r["start"]) for r in dictionary.literal_matches(t, "k", unique, "value", fold).collect()}
        assert got == brute(texts, needles if not fold else sorted({x.lower() for x in needles}), fold)


def test_containing_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["one", "two", "three", "four", "five"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    needles = [(i, " ".join(rng.choice(texts)[1].split(" ")[rng.randint(0, 3):][:rng.randint(1, 14)])) for i in range(40)]
    needles = [(i, v[1:] if i % 3 == 0 else v) for i, v in needles if len(v) > 1]
    t, n = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(needles, "i int, value string")
    got = {tuple(r) for r in containment.containing_pairs(t, "k", n, "i", "value").collect()}
    assert got == {(k, i) for k, text in texts for i, v in needles if v and v in text}


def test_carryover_needs_one_foreign_owner(spark):
    footer = "this note is privileged and must not leave the firm"
    corpus = spark.createDataFrame([("a", "our own long sentence about the blue ledger here " + footer), ("b", "painted ledger seven kept behind the mill counter since " + footer), ("c", footer)], "matter_id string, text string")
    drafts = spark.createDataFrame([(1, "a", "They said: Painted ledger seven kept behind the mill! " + footer), (2, "a", "our own long sentence about the blue ledger"), (3, "a", "too short")], "draft_id int, matter_id string, text string")
    rows = carryover.carryover_hits(drafts, corpus).collect()
    assert [(r["draft_id"], r["owner"], r["evidence"]) for r in rows] == [(1, "b", "Painted ledger seven kept behind the mill")]


def test_left_out_matches_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, f"s{i % 4}", " ".join(rng.choice("abc") for _ in range(rng.randint(4, 14)))) for i in range(40)]
    def grams(text):
        w = text.split()
        return {" ".join(w[i:i + 6]) for i in range(len(w) - 5)}
    want = set()
    for d, s, text in docs:
        for g in grams(text):
            owners = {s2 for d2, s2, t2 in docs if d2 != d and g in grams(t2)}
            if len(owners) == 1 and s not in owners:
                want.add((d, owners.pop()))
    got = {(r["draft_id"], r["owner"]) for r in carryover.left_out_grams(spark.createDataFrame(docs, "doc_id int, matter_id string, text string")).collect()}
    assert got == want and want


def test_partial_forms_and_common_words(spark):
    rows = spark.createDataFrame([("Dr. Mei-Lin Chen Barros", "name"), ("Continental Guild of Culinary Arts", "org"), ("Acme", "org")], "v string, k string")
    got = [r[0] for r in rows.select(facts.partial_forms(F.col("v"), F.col("k"))).collect()]
    assert got == [["Mei-Lin", "Barros"], ["Continental", "Guild"], []]


def test_ensemble_skips_failing_detector(spark):
    texts = spark.createDataFrame([(1, "mail a@b.org now")], "id int, text string")
    detect.register_detector("broken", lambda df, key, text: df.select("missing"))
    skipped, reasons = [], {}
    rows = detect.ensemble(texts, "id", ["broken", "rules", "unknown"], skipped=skipped, reasons=reasons).collect()
    assert [(r["start"], r["end"], r["kind"]) for r in rows] == [(5, 12, "email")] and skipped == ["broken", "unknown"]
    assert reasons["unknown"] == "unknown" and "missing" in reasons["broken"]


def test_containing_pairs_at_every_offset(spark):
    rng = random.Random(11)
    body = "".join(rng.choice("abc é-\n") for _ in range(260))
    texts = [(0, body), (1, body[:150] + "#" + body[151:]), (2, "x" * 500), (3, None), (4, ""), (5, body[100:] * 2), (6, body)]
    needles = [(i, body[i:i + n]) for n in (31, 40, 57) for i in range(0, 200)] + [(900, "x" * 41), (901, "x" * 501), (902, None), (903, ""), (904, body * 3)]
    needles = [(k + 1000 * (n is not None and len(n)), n) for k, n in needles]
    t, n = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(needles, "i int, value string")
    got = [tuple(r) for r in containment.containing_pairs(t, "k", n, "i", "value").collect()]
    assert sorted(got) == sorted((k, i) for k, text in texts for i, v in needles if v and text and v in text)
    assert containment.containing_pairs(t, "k", n.where("false"), "i", "value").count() == 0


def test_fingerprints_of_a_part_are_fingerprints_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    for block in (winnow.BLOCK, 50):
        monkeypatch.setattr(winnow, "BLOCK", block)
        strings = [rng.integers(0, 3, n, np.uint8) for n in (0, 39, 40, 41, 300, 0, 90)]
        bounds = np.cumsum([0, *map(len, strings)])
        found = [set() for _ in strings]
        for of, numbers in winnow.fingerprints_of(np.concatenate(strings), bounds, 40):
            for k, h in zip(of.tolist(), numbers.tolist(), strict=True):
                found[k].add(h)
        assert [bool(x) for x in found] == [len(s) >= 40 for s in strings]
        for whole, mine in zip(strings, found, strict=True):
            for i in range(len(whole) - 39):
                part = next(winnow.fingerprints_of(whole[i:i + 40], np.array([0, 40]), 40))[1].tolist()
                assert len(part) == 1 and part[0] in mine
        assert len(found[4]) < 300 / 6


def test_contaminated_matches_brute_force(spark):
    rng = random.Random(13)
    held = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randint(3, 30)))) for i in range(25)]
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, f"  so {v} it ends") for i, v in held[:8]] + [(200, " \n"), (201, None), (202, held[3][1][4:-3] + " ")]
    got = sorted(r[0] for r in containment.contaminated(spark.createDataFrame(rows, "k int, text string"), "k", spark.createDataFrame(held, "i int, text string"), "i", 40).collect())
    long = [v.strip() for _, v in held if len(v.strip()) >= 40]
    assert got == sorted(k for k, text in rows if text is not None and any(v in text or text.strip() in v for v in long))


def test_sieve_keeps_every_key_and_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    passes = sieve.sieve(keys, "key", 5000)
    assert keys.where(passes(F.col("key"))).count() == 5000
    assert spark.range(5000, 45_000).where(passes(F.xxhash64("id"))).count() < 40_000 / 40
    assert spark.range(100).where(sieve.sieve(keys.where("false"), "key", 0)(F.xxhash64("id"))).count() == 0
    assert sieve.words_for(0) == sieve.LEAST_WORDS and sieve.words_for(10**12) == sieve.MOST_WORDS


def test_a_long_literal_does_not_widen_the_rows_before_the_join(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(300)]
    needles = [" ".join(rng.choice(texts)[1].split()[3:6]) for _ in range(30)]
    long = " ".join(rng.choice(words) for _ in range(500))
    t, sizes = spark.createDataFrame([*texts, (999, f"so {long} on")], "k int, text string"), []
    for literals in (needles, [*needles, long]):
        keyed = dictionary._keyed_literals(spark.createDataFrame([(x,) for x in literals], "value string"), "value", False)
        shapes = keyed.groupBy("a", "b").agg(F.max("n_pieces").alias("reach"), F.count("*").alias("rows")).collect()
        offered = dictionary.offered_keys(t.where("k < 999"), ["k"], "text", False, shapes, sieve.sieve(keyed, "key", len(literals)))
        sizes.append(offered.count())
    assert sizes[1] <= 1.05 * sizes[0] < 300 * 80 / 20
    got = {(r["k"], r["value"]) for r in dictionary.literal_matches(t, "k", spark.createDataFrame([(x,) for x in {*needles, long}], "value string"), "value", False).collect()}
    assert got == {(k, v) for k, text in [*texts, (999, f"so {long} on")] for v in {*needles, long} if v in text}


def test_left_out_grams_are_shuffled_once_and_a_common_one_thrice_a_part(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    docs = [(i, f"m{i % 7}", f"{body(i)} a tail that every single text of them has") for i in range(60)] + [(60, "m1", body(3)), (61, "m4", body(4)), (62, "m0", body(4))]
    corpus = spark.createDataFrame(docs, "doc_id int, matter_id string, text string")
    hits = carryover.left_out_grams(corpus)
    assert hits._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(h1") == 1
    got = {(r["draft_id"], r["matter_id"], r["owner"]) for r in hits.collect()}
    assert got == {(3, "m3", "m1"), (60, "m1", "m3"), (62, "m0", "m4")}


def test_left_out_phrases_of_a_null_matter_and_of_repeated_rows(spark):
    rows = [(1, None, "one two three four five six seven"), (2, "b", "zero one two three four five six seven"), (2, "b", "zero one two three four five six seven"), (3, "c", "nothing else in here at all today")]
    got = carryover.left_out_phrases(spark.createDataFrame(rows, "doc_id int, matter_id string, text string")).collect()
    # grams of a null owner are not merged; a repeated row tells each of its grams again
    assert sorted((r["draft_id"], r["owner"] or "", r["first"], r["last"], r["grams"]) for r in got) == [(1, "b", 0, 6, 2), *2 * [(2, "", 1, 6, 1)], *2 * [(2, "", 2, 7, 1)]]


def test_corpus_is_dealt_in_parts_whatever_its_files(spark, monkeypatch):
    monkeypatch.setattr(carryover, "PART_ROWS", 10)
    docs = spark.range(95).selectExpr("nullif(id, 3) as doc_id", "string(id % 5) as matter_id", "'one two three four five six seven ' || id as text").coalesce(1)
    parts = carryover.dealt(docs)
    assert parts.rdd.getNumPartitions() == 10 and parts.count() == 95
    owners = {tuple(r) for r in carryover.gram_owners(parts).groupBy("owners").count().collect()}
    assert owners == {(1, 95), (5, 2)}
    assert carryover.left_out_grams(docs).count() == 0  # each gram that is shared is one of five matters


def test_left_out_phrases_shuffle_no_position_that_misses(spark):
    docs = spark.createDataFrame([(i, f"m{i % 3}", " ".join(f"w{i}x{k}" for k in range(50)) + " the very same tail of six words and more" * (i < 2)) for i in range(30)], "doc_id int, matter_id string, text string")
    phrases = carryover.left_out_phrases(docs)
    assert {(r["draft_id"], r["owner"], r["grams"]) for r in phrases.collect()} == {(0, "m1", 4), (1, "m0", 4)}
    plan = phrases._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("getbit") >= 2 and "Filter" in plan


def test_literals_that_share_a_key_meet_a_place_once_for_each_length(spark):
    values = [f"the grey ledger {n} kept" for n in range(1000, 3000)]
    keyed = dictionary._keyed_literals(spark.createDataFrame([(v,) for v in values], "value string"), "value", False)
    shapes = [r.asDict() for r in keyed.groupBy("a", "b").agg(F.max("n_pieces").alias("reach"), F.count("*").alias("rows")).collect()]
    t = spark.createDataFrame([(k, f"Recall the grey ledger {k + 1000} kept here.") for k in range(50)], "k int, text string")
    offered = dictionary.offered_keys(t, ["k"], "text", False, shapes, lambda key: F.lit(True)).join(keyed.select("key").distinct(), "key")
    cut = dictionary.pieces_of_lengths(offered, ["k"], dictionary.lengths_of(keyed, "value", []), [], False, lambda key: F.lit(True))
    assert cut.count() == 50
    got = {(r["k"], r["value"]) for r in dictionary.literal_matches(t, "k", spark.createDataFrame([(v,) for v in values], "value string"), "value", False).collect()}
    assert got == {(k, f"the grey ledger {k + 1000} kept") for k in range(50)}


def test_places_of_long_texts_and_of_short_ones_are_told_alike(spark, monkeypatch):
    from veilspan.operators import dictionary, facts

    values = [(f"M{i}", i, "names", 0, v) for i, v in enumerate(("Ada Lind", "Ümit Öz", "$1,250", "the red ledger", "Zed"))]
    dim = spark.createDataFrame(values, "matter_id string, matter_ord int, category string, ord int, value string")
    body = "Ada Lind paid x$1,2500 to Ümit Öz,  not\u0001 the red ledger of Zed-Lind"
    texts = spark.createDataFrame([(0, body), (1, " ".join([body] * 30)), (2, ""), (3, None), (4, "Zed")], "id int, text string")
    want = sorted((i, at, v) for i, t in texts.collect() if t for _, _, _, _, v in values for at in range(len(t)) if t.startswith(v, at))
    hits = facts.fact_hits(texts, "id", dim)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(_held" in plan  # pieces are told from rows, not inside one expression of the whole text
    assert sorted((r["id"], r["start"], r["entity"]) for r in hits.collect()) == want
    shorts = sorted(map(str, facts.partial_hits(texts, "id", dim).collect()))
    assert "posexplode(_runs" in facts.partial_hits(texts, "id", dim)._jdf.queryExecution().optimizedPlan().toString()
    for few in (0, 10**6):
        monkeypatch.setattr(dictionary, "FEW_PIECES", few)
        monkeypatch.setattr(facts, "FEW_PIECES", few)
        assert sorted((r["id"], r["start"], r["entity"]) for r in facts.fact_hits(texts, "id", dim).collect()) == want
        assert sorted(map(str, facts.partial_hits(texts, "id", dim).collect())) == shorts
