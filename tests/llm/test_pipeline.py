from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from veilspan.llm import packing, pii, quality

SF = "/root/testdata/sf0.001"


def plain_pairs(texts):
    """The least place each row can reach over pairs of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 5 * (n := len(a & b)) >= 4 * (len(a) + len(b) - n)]
    for i, j in pairs:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    return pairs, [find(i) for i in range(len(texts))]


def test_run_matches_its_stages_in_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r for r in docs.collect() if quality.judge((r["text"] or "").encode(), model)[-1]]
    good.sort(key=lambda r: r["doc_id"])
    _, roots = plain_pairs([r["text"] for r in good])
    ones = [good[i]["doc_id"] for i in sorted(set(roots))]
    texts = {r["doc_id"]: r["text"] for r in good}
    p = pii.Pseudonyms(pii.key_of(spark))
    from veilspan.llm.encoding import encoder, vocabulary

    encode = encoder(vocabulary(spark, packing.TOKENIZER))
    wanted = {}
    for i in ones:
        text = pii.rewritten(texts[i], pii.found(texts[i], p))
        wanted[i] = [*encode.encode([text.encode()])[0].tolist(), 0]
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == wanted and len(wanted) < len(good) < docs.count()


def test_stages_return_the_columns_of_documents_and_bear_odd_rows(spark, odd_docs, no_docs):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (odd_docs, no_docs):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
    assert columns and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "private data", "packing"]


def test_all_operators_are_registered():
    names = Counter(k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op"))
    assert names == Counter(f"op{n}" for n in range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["op1_url_cascade"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    theirs = con.sql(__spark_entry__.oracle_sql()[name])
    mine = __spark_entry__.queries()[name](spark, SF)
    order = [theirs.columns.index(c) for c in mine.columns]
    assert Counter(tuple(r) for r in mine.collect()) == Counter(tuple(r[i] for i in order) for r in theirs.fetchall())
