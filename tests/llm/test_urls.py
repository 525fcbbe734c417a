import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import urls

PAGES = "page_id long, url string, html string, host string, listed boolean, verdict string"


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    listed = any(x in urls.LISTED_NAMES for x in host.split("."))
    return host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if listed else "allow"


def test_verdicts_match_a_plain_reading(spark):
    odd = [
        None, "", "no scheme", "http://", "http://X.COM", "http://example.com/en/", "http://www.example.com/en/x?y", "https://a.net/es/#q", "http://NET/fr/1", "http://free-bets.org?x/", "http://a.free-bets.org/p",
        "http://free-bets/", "http://xfree-bets.org/", "http://ÄB.com/", "http://a.b/c\nd://e", "x://y://z/en/", "http://example.com/en", "http://user@example.com:80/en/", "http://...", "http://www.example.com/en/x?y",
    ]
    rows = [(i if i % 5 else None, u, None, "h", True, "v") for i, u in enumerate(odd)]
    pages = spark.createDataFrame(rows, PAGES)
    got = urls.judge(pages, urls.RULES, urls.hosts_named(pages, urls.LISTED_NAMES)).collect()
    assert sorted((r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == sorted((h, p, r or "", v) for h, p, r, v in map(plain_verdict, odd))
    none = spark.createDataFrame([], PAGES)
    assert urls.judge(none, urls.RULES, urls.hosts_named(none, urls.LISTED_NAMES)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, [], urls.hosts_named(pages, [])).collect()} == {"allow"}


def test_the_list_is_a_table(spark):
    hosts = ["a.b.org", "b.org", "x.b.org.uk", "c.com", "www.c.com", "d.net", "", "org"]
    pages = spark.createDataFrame([(i, f"https://{h}/p", None, "h", True, "v") for i, h in enumerate(hosts)] + [(None, None, None, None, None, None)], PAGES)
    listed = spark.createDataFrame([("b.org",), ("c.com",), ("c.com",), (None,), ("not-met.example",), ("uk",)], "key string")
    got = urls.judge(pages, [], listed).collect()
    assert sorted(r["host"] for r in got if r["verdict"] == "block") == sorted(["a.b.org", "b.org", "x.b.org.uk", "c.com", "www.c.com"]) and len(got) == 9


def test_cascade_is_exact_over_its_universe(spark):
    random.seed(4)
    keys = spark.createDataFrame([(f"k{i}", random.random() < 0.2) for i in range(4000)], "key string, listed boolean")
    cascade = urls.build(keys, shard_keys=1000, group_bytes=150, bits_per_key=2)  # many false positives, so many levels
    depth = [len(r["levels"]) for r in cascade.filters.collect()]
    assert cascade.shards > 1 and 1 < len(cascade.groups) <= len(depth) and max(depth) > 2
    assert urls.mark_listed(F.array("key"), cascade, keys, "found").where("found <> listed").count() == 0


def test_levels_are_exact_and_end():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, 20_000) for _ in range(2))
    for share in (0, 0.001, 0.5, 1):
        listed = rng.random(20_000) < share
        levels = urls.levels_of(a, b, listed)
        assert (urls.found(levels, a, b) == listed).all() and sum(map(len, levels)) <= 3 * listed.sum() + 1000
    with pytest.raises(ValueError, match="same 128 bits"):
        urls.levels_of(np.zeros(2, np.int64), np.zeros(2, np.int64), np.array([True, False]))
