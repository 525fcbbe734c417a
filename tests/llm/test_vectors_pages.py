import time

import numpy as np
from pyspark.sql import functions as F

from veilspan.llm import ann, pages

VECTORS = "vec_id long, embedding array<float>, label int, rep long, bucket int"


def plain_nearest(rows, k, every):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for q, x in good:
        if q % every == 0:
            near = sorted((-(x * y).sum(), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_exact_where_all_axes_are_probed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # one vector many times, more than a result holds
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (305, [float("inf")] + [0.0] * 7), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (420, [-0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECTORS)
    got = found(ann.search(df, k=20, every=20, tables=2, probes=32, slice_rows=37))
    want = plain_nearest(rows, 20, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12) for q in got)
    assert ann.search(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = found(ann.search(df)), plain_nearest(rows, 20, 20)
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_recall_with_lengths_that_differ(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x *= (rng.lognormal(sigma=0.5, size=3000) / np.linalg.norm(x, axis=1))[:, None]
    x[1234] *= 100  # one outlier
    x[1300] *= 1e-200
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(ann.search(df)), plain_nearest(rows, 20, 20)
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    exact = found(ann.search(df, sure=1.1, tables=1, probes=1, slice_rows=700))
    assert {q: [i for i, _ in v] for q, v in exact.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_rotation_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(9, 13))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def text(html, template=frozenset()):
    return pages.text_of(pages.slots(pages.parse(html)[1], template))


def test_article_without_its_surroundings():
    body = (
        "<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- x --><div class=\"ad\">Buy</div>"
        "<main><article><h1>A &amp; B</h1><p><b>One<br>two  <i>th</i>ree&nbsp;four<p>Five &lt;six&gt;<form>q <input></form><aside>related</aside><ul><li>a<li>b</ul><div class='reader comments'><p>nice</p></div></article></main>"
        "<div id=sidebar><p>side</p></div><footer>&copy; me</footer>"
    )
    assert text(page(body)) == "A & B\n\nOne two three four\n\nFive <six>\n\na\n\nb"
    for odd in ("", "<", "<p", "<article>", "</div></p>", "<script>x", "<!-- x", "<p>a</b></p", "a < b"):
        text(odd)
    assert text("a < b") == "a < b" and text("<p>x</p><script>y") == "x"


def test_template_is_left_out_where_no_article_is_marked(spark):
    rows = [(i, f"https://h.example/{i}", page(f"<div class=top>Daily News</div><div class=c><h2>Title {i}</h2><p>Body of page number {i}.</p></div><div class=end>All rights</div>")) for i in range(8)]
    rows += [(100, None, None), (101, "x", ""), (102, "https://one.example/", page("<p>alone</p>")), (None, "https://h.example/0", rows[0][2]), (0, "https://h.example/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, token int")
    got = {(r["page_id"], r["url"]): r for r in pages.extract(df).collect()}
    assert got[3, "https://h.example/3"]["text"] == "Title 3\n\nBody of page number 3."
    assert got[100, None]["text"] == "" and got[101, "x"]["n_chars"] == 0 and got[102, "https://one.example/"]["text"] == "alone"
    assert pages.extract(df).count() == len(rows) and pages.extract(df.limit(0)).count() == 0


def test_template_is_left_out_of_articles_but_copies_stay_whole(spark):
    def page(body):
        return f"<html><body><div class='x1'>Top line</div><article>{body}<p class='x2'>Read more on our site</p></article></body></html>"

    rows = [(i, f"https://one.example/{i}", page(f"<p>Story number {i} is told here at some length</p>").encode()) for i in range(6)]
    rows += [(10 + i, f"https://two.example/{i}", page(f"<p>All pages here tell the same story in the same words but for {i}</p><p>And they all tell it to the end, word by word</p>").encode()) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html binary")).collect()}
    assert [got[i] for i in range(6)] == [f"Story number {i} is told here at some length" for i in range(6)]
    assert got[12] == "All pages here tell the same story in the same words but for 2\n\nAnd they all tell it to the end, word by word\n\nRead more on our site"


def test_given_pages_give_their_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in df.join(pages.extract(df).select("page_id", F.col("text")), "page_id").collect():
        inner = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        import html
        import re

        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def recall(spark, rows, **how):
    got = found(ann.search(spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECTORS), **how))
    want = plain_nearest(rows, 20, 20)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def unit(n, dim, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_with_skewed_lengths_and_an_outlier(spark):
    x = unit(1200, 64)
    skewed = x * np.random.default_rng(5).lognormal(0, 0.5, (len(x), 1))
    outlier = x.copy()
    outlier[7] *= 10
    for vectors in (skewed, outlier):
        assert recall(spark, list(enumerate(vectors.astype(np.float32).tolist()))) >= 0.9


def test_all_candidates_where_they_are_few(spark):
    # equal lengths, exact in float, so that the tables are probed and a second pass completes them
    signs = np.random.default_rng(6).choice([-1.0, 1.0], (40, 64))
    few = [(i, v) for i, v in enumerate(signs[:25].tolist())]
    rare = [(1000 + i, v) for i, v in enumerate(np.random.default_rng(7).choice([-1.0, 1.0], (15, 32)).tolist())]
    assert recall(spark, few[:15]) == 1 and recall(spark, few + rare) == 1


def test_no_name_loses_an_article():
    assert text('<body><article class="share-alike"><p>Whole text</p></article></body>') == "Whole text"
    assert text('<div class="page-with-sidebar"><article><p>A</p></article><div class="sidebar">no</div></div>') == "A"
    assert text('<article><p class="copyright-law">On law</p><p class="copyright">(c)</p><div class="post-comments">c</div><div id="adSlot">x</div></article>') == "On law"
    assert text('<div class="sidebar"><article><p>Only one</p></article></div>') == "Only one"
    assert text('<article><div class="comments"><p>All there is</p></div></article>') == "All there is"
    assert text('<div class="related"><article>teaser</article></div><article>real</article>') == "real"


def test_stray_end_tags_cost_one_lookup_each():
    began = time.perf_counter()
    assert text("<div>" * 3000 + "<b>" * 20_000 + "</i></p>" * 40_000 + "text") == "text"
    assert time.perf_counter() - began < 10
