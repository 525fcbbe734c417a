from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from veilspan.llm import near

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_pairs(texts):
    """All pairs of equal sets or of similarity 0.8 or more, and the least place each row can reach."""
    sets, pairs, root = [plain_set(t) for t in texts], [], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * (n := len(a & b)) >= 4 * (len(a) + len(b) - n):
                pairs.append((i, j))
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return pairs, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("slice_shingles", [near.SLICE_SHINGLES, 500])
def test_groups_match_all_pairs_by_jaccard(spark, slice_shingles):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    _, roots = plain_pairs([t for _, t in rows])
    wanted = {rows[i][0]: rows[k][0] for i, k in enumerate(roots)}
    groups = {}
    for r in near.grouped(docs, slice_shingles=slice_shingles).collect():
        groups.setdefault(bytes(r["root"]), []).append(r["doc_id"])
    assert {i: min(g) for g in groups.values() for i in g} == wanted


def test_pipeline_stage_joins_near_copies_that_differ_in_many_bits(spark, odd_docs, no_docs):
    words = [f"w{i}" for i in range(120)]
    copy = [*words[:30], "x", *words[31:90], "y", *words[91:]]  # 106 of 126 shingles are shared
    other = [*words[:20], "x", *words[21:45], "y", *words[46:70], "z", *words[71:]]  # 101 of 131 with the first
    docs = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in enumerate((words, copy, other))], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).collect()) == [0, 2]
    kept = Counter((r["doc_id"], r["text"]) for r in stage(spark, odd_docs, SF).collect())
    assert kept == Counter({(r["doc_id"], r["text"]): 1 for r in odd_docs.collect() if r["doc_id"] not in (2, 4, 5, 7) and (r["doc_id"], r["text"]) != (None, None)})
    assert stage(spark, no_docs, SF).count() == 0


def test_fingerprints_and_pivots_find_candidates_that_no_band_holds(spark):
    words = [f"w{i}" for i in range(400)]
    far = [w if i % 20 else "x" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, [*words[:-1], "end"], far))], "doc_id long, text string")
    distinct = near.marked(docs).selectExpr("set_key", "struct(false as unnamed, doc_id, text_key) as first", "size", "fp", "array(xxhash64(set_key)) as buckets")
    keys = {r["first"]["doc_id"]: bytes(r["set_key"]) for r in distinct.collect()}
    found = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in near.links(docs, distinct).collect()}
    assert found == {frozenset((keys[0], keys[1]))}


def test_recall_of_the_bands_at_the_threshold():
    rng, met = np.random.default_rng(3), 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 100, np.uint64)
        met += any(a == b for a, b in zip(near.buckets(np.sort(pool[:90])), near.buckets(np.sort(pool[10:])), strict=True))  # similarity 0.8
    assert met >= 0.995 * 2000
