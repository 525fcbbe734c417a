"""License rules, periodic runs and spelling variants against plain versions of them."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from veilspan.llm import licenses, runs, variants

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string"


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    form = "".join(f"~{w} " for w in words)
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found = []
    for place, (priority, label, tokens) in enumerate(licenses.RULES):
        for m in re.finditer(licenses.pattern(tokens), form):
            start = form[: m.start()].count("~")
            found.append((start, start + m[0].count("~"), priority, place, label))
    kept = [a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and b[2] <= a[2] and (b[1] - b[0] > a[1] - a[0] or b[3] < a[3]) for b in found)]
    labels = sorted({label for _, label in base} | {a[4] for a in kept})
    at = [i for i, _ in base]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(labels), max((licenses.WEIGHTS[a[2]] for a in kept), default=0.0)


LICENSE_TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "This is GPLv3. LGPL v2.1 too, and the GNU Lesser General Public License version 2.1 or (at your option) any later version",
    "mit license mit license MIT\nLICENSE general public license", "permit license; mit licenses; émit license; mit\x00license; İmit license; Kurl license curl license",
    "CC BY-NC-SA 4.0, https://creativecommons.org/licenses/by-sa/3.0/ and Creative Commons Attribution 4.0 International License",
    "Neither the name of the Great Big University of Somewhere nor the names of its contributors may be used to endorse or promote products derived. Redistribution",
    "Released into the public domain. All rights reserved. Mozilla Public License, v. 2.0; BSD 3-Clause License; 3-clause BSD license; zero-clause BSD license",
    "general public license", "license " * 300, ("the mit license and apache license 2.0 " * 700) + "end", "gnu general public license " * 3 + "apache software license 1.1",
]


def test_license_rules_match_a_plain_scan(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(LICENSE_TEXTS)] + [(None, "mit license")]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd_docs.select("doc_id", "text"))
    wanted = Counter((r["doc_id"], *plain_scan(r["text"])) for r in docs.collect())
    assert Counter(map(tuple, licenses.digest(licenses.scan(docs)).collect())) == wanted
    assert Counter(map(tuple, licenses.digest(licenses.scan(odd_docs)).collect())) == Counter((r["doc_id"], *plain_scan(r["text"])) for r in odd_docs.collect())
    assert licenses.digest(licenses.scan(no_docs)).count() == 0


def test_every_license_rule_passes_its_gates_and_finds_its_own_words(spark):
    listed = licenses.RULES
    assert len(listed) > 300 and sum(len(g["rules"]) for g in licenses.gates(listed)) == len(listed)

    def sample(tokens):
        words = [t.removesuffix("?").split("|")[0] for t in tokens.split()]
        return " ".join(re.sub(r"\[(.).*?\]", r"\1", w).replace("v?", "v").replace(".+", "some body").replace(".*", "") for w in words)

    texts = [(i, sample(tokens)) for i, (_, _, tokens) in enumerate(listed)]
    alone = spark.createDataFrame(texts, DOCS)
    got = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in licenses.scan(alone).collect()}
    for i, (priority, label, _) in enumerate(listed):
        assert got[i], texts[i]
        if priority < 4:
            assert any(x == label or x.startswith(label) or label.startswith(x) for x in got[i]), (texts[i], got[i])


def test_license_scan_has_no_python_worker_and_no_shuffle(spark):
    plan = licenses.op11_license_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def plain_runs(words, least_length=6, least_exponent=4):
    found = []
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least_length, least_exponent * q) and not any(words[i : i + size - p] == words[i + p : i + size] for p in range(1, q)):
                found.append((i, size, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_run_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words_match_all_periods_tried():
    rng = random.Random(5)
    for _ in range(1500):
        length, exponent, letters = rng.choice([2, 6]), rng.choice([2, 3, 4]), rng.choice([1, 2, 3, 5])
        words = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(45))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = words[: rng.randrange(1, 6)] * rng.randrange(8)
        got = runs.runs_of([words, [], words[:7], words], length, exponent)
        assert [tuple(map(int, r)) for r in got[3]] == plain_runs(words, length, exponent), words
        assert len(got[0]) == len(got[3]) and not len(got[1])


def test_runs_of_long_periods_and_a_long_text():
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 600:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    root = [b"%d" % i for i in range(400)]
    for words in (fibonacci[1], root * 5 + root[:37], [b"x"] * 700, [*root, *([b"u", b"v", b"v"] * 50), *root]):
        assert [tuple(map(int, r)) for r in runs.maximal_runs(np.unique(words, return_inverse=True)[1], 4, 2)] == plain_runs(words, 4, 2)
    words = root * 300  # one run over 120,000 words
    assert [tuple(map(int, r)) for r in runs.runs_of([words])[0]] == [(0, len(words), 400)]


def test_tree_extensions_and_orders_match_comparing_suffixes():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 30, 80):
        row = rng.integers(1, 4, size).tolist()
        tree = runs.SuffixTree(row, opposite=True)
        suffixes = [[*row[i:], 0] for i in range(size + 1)]
        assert np.argsort(tree.ranks).tolist() == sorted(range(size + 1), key=lambda i: suffixes[i])
        assert np.argsort(tree.back_ranks).tolist() == sorted(range(size + 1), key=lambda i: [-x if x else -9 for x in suffixes[i]])
        pairs = [(i, j) for i in range(size + 1) for j in range(size + 1) if i != j]
        if pairs:
            i, j = np.array(pairs).T
            same = [next(k for k, (x, y) in enumerate(zip(suffixes[a] + [-1], suffixes[b] + [-2])) if x != y) for a, b in pairs]
            assert tree.extension(i, j).tolist() == same


def test_run_query_matches_a_plain_version(spark, sample, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect() if len(r["text"] or "") < 4000]
    tail = [(i, " ".join(f"w{k % 9}" for k in range(60 + i))) for i in range(1000, 1060)]
    docs = spark.createDataFrame(rows + tail, DOCS)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if len(r["text"] or "") < 4000]
    some = odd_docs.where("length(text) < 4000 or text is null")
    for df, plain in ((docs, rows + tail), (some, odd)):
        got = runs.digest(runs.find(df, words=runs.planted)).collect()
        assert Counter(map(tuple, got)) == Counter(plain_run_row(i, t) for i, t in plain)
    assert runs.digest(runs.find(odd_docs)).count() == odd_docs.count() and runs.digest(runs.find(no_docs)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in runs.find(spark.createDataFrame([(1, "so " + "ha " * 9 + "he said"), (2, "a b c")], DOCS)).collect()}
    assert texts == {1: "so ha he said", 2: "a b c"}


def plain_variants(docs, least_count=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least_count}
    near, gaps = {w: set() for w in counts}, {}
    for w in counts:
        for i in range(len(w)):
            gaps.setdefault((len(w), i, w[:i] + w[i + 1 :]), set()).add(w)
            if (d := w[:i] + w[i + 1 :]) in near:
                near[w].add(d)
                near[d].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(x, key=lambda y: (-counts[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return Counter((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def all_variants(docs, **kwargs):
    return Counter(map(tuple, variants.grouped(variants.vocabulary(variants.misspelt(variants.occurrences(docs))), **kwargs).collect()))


@pytest.mark.parametrize("symbols", [variants.SYMBOLS, 2])
def test_variants_match_a_plain_version(spark, sample, symbols):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    wanted = plain_variants(rows)
    assert sum(r[1] is not None for r in wanted) > 100
    assert all_variants(sample, symbols=symbols) == wanted


def test_variants_of_odd_texts(spark, odd_docs, no_docs):
    assert all_variants(odd_docs) == plain_variants([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert not all_variants(no_docs)
    long = "".join("abcdefghij"[(i * i) % 7] for i in range(30_000))
    words = [long, long[:100] + long[101:], "straße", "strasse", "STRASSE", "École", "école", "aaaaaa", "aaaaa", "baaaaa", "aaaaab", "abaaaa", "chain", "chains", "xchains", "×÷×÷×"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(3 << (k % 5)))
    docs = spark.createDataFrame([(None, text), (None, text), (7, "chain " * 40 + "chains " * 90 + "x1y_chain")], DOCS)
    assert all_variants(docs) == plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_neighbourhood_meets_every_word_one_edit_away_exactly_once():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
        others = {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in ("", *"abcé") for k in (0, 1)} - {a, ""}
        for b in others:
            (ka, kb), made = variants.keys([a, b], 4).tolist(), [Counter(k for _, ks in variants.neighbourhoods([w], 4) for k in ks.tolist()) for w in (a, b)]
            assert ka == kb or made[0][kb] + made[1][ka] == 1, (a, b)


def test_sql_of_the_license_query_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    theirs = con.sql(licenses._sql())
    mine = licenses.op11_license_rules(spark, SF)
    assert theirs.columns == mine.columns and Counter(map(tuple, theirs.fetchall())) == Counter(map(tuple, mine.collect()))
