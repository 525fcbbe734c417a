"""Tenant-scoped reads: search and page reads inside a grant, and the checks that attack them.

``grants``: ``principal, source_id``. ``pages``: ``source_id, slug, title, chunk_text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions.spans import unnest
from veilspan.functions.text import blank_words

ALL_SOURCES = "__all__"


def keywords(task):
    """Words longer than two characters, or the whole task when there are none."""
    long = F.filter(blank_words(task), lambda w: F.length(w) > 2)
    return F.when(F.size(long) > 0, long).otherwise(F.array(task))


def allowed(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests with ``scope``: the granted source they may search, null when refused.

    No source or all sources means the grant; a foreign source is refused.
    """
    joined = requests.join(grants.select("principal", F.col("source_id").alias("granted")), "principal", "left")
    asked = F.col("asked_source")
    return joined.withColumn("scope", F.when(asked.isNull() | (asked == ALL_SOURCES) | (asked == F.col("granted")), F.col("granted"))).drop("granted")


def search(requests: DataFrame, grants: DataFrame, pages: DataFrame) -> DataFrame:
    """``request_id, slug, source_id, score`` (distinct keywords found), only inside the grant.

    Keywords and pages meet on (source, word-start) keys, so a request reads the
    pages of its own source only and a common keyword does not reach other tenants.
    """
    from veilspan.operators.dictionary import literal_matches

    scoped = allowed(requests, grants).where(F.col("scope").isNotNull())
    terms = unnest(scoped, keywords(F.col("query")), "term", "request_id", F.col("scope").alias("source_id"))
    needles = terms.select("source_id", F.lower("term").alias("term")).distinct()
    texts = pages.select(F.struct("source_id", "slug").alias("page"), "source_id", F.col("chunk_text").alias("text"))
    found = literal_matches(texts, "page", needles, "term", ignore_case=True, scope=["source_id"]).select("page", "source_id", "term").distinct()
    wanted = terms.select("request_id", "source_id", F.lower("term").alias("term")).distinct()
    hits = wanted.join(found, ["source_id", "term"])
    return hits.groupBy("request_id", F.col("page.slug").alias("slug"), "source_id").agg(F.count("*").alias("score"))


def get_page(requests: DataFrame, grants: DataFrame, pages: DataFrame) -> DataFrame:
    """``request_id, slug, source_id, outcome, title, chunk_text``; a foreign page is refused, not "not found".

    A request for a named source gives one row, whatever else its principal may read. A request for all sources gives a row for each
    granted source that has the page, or one row that says there is none.
    """
    asked = F.nullif("asked_source", F.lit(ALL_SOURCES))
    given = grants.select("principal", F.col("source_id").alias("granted")).distinct()
    shelf = pages.withColumn("_page", F.lit(True))
    named = requests.where(asked.isNotNull()).withColumn("source_id", asked)
    own = given.select("principal", F.col("granted").alias("source_id"), F.lit(True).alias("_mine"))
    one = named.join(own, ["principal", "source_id"], "left").join(shelf, ["source_id", "slug"], "left")
    every = requests.where(asked.isNull()).join(given, "principal", "left").withColumn("source_id", F.col("granted"))
    read = every.join(shelf, ["source_id", "slug"], "left").withColumn("_mine", F.col("granted").isNotNull())
    request = W.partitionBy("request_id")  # as many rows as the principal has grants
    found = F.count("_page").over(request)
    shown = read.withColumn("_found", found).withColumn("_place", F.row_number().over(request.orderBy("source_id")))
    several = shown.where(F.col("_page").isNotNull() | ((F.col("_found") == 0) & (F.col("_place") == 1)))
    columns = ["request_id", "slug", "source_id", "_mine", "_page", "title", "chunk_text"]
    outcome = F.when(F.col("_mine").isNull() | ~F.col("_mine"), "permission_denied").when(F.col("_page").isNull(), "page_not_found").otherwise("ok")
    ok = outcome == "ok"
    return one.select(*columns).unionByName(several.select(*columns)).select(
        "request_id", "slug", "source_id", outcome.alias("outcome"), F.when(ok, F.col("title")).alias("title"), F.when(ok, F.col("chunk_text")).alias("chunk_text")
    )


ATTACK_CHECKS = ("own_recall", "control", "foreign_search", "all_sources", "direct_read")


def attack_checks(pairs: DataFrame, grants: DataFrame, pages: DataFrame) -> DataFrame:
    """Five checks per (attacker, target) pair: ``pair_id, check, hits, passed``.

    ``pairs``: ``pair_id, attacker, target, attacker_query, target_query, target_slug``
    with each party's own source equal to its grant.
    """
    cases = pairs.select(
        "pair_id", F.col("attacker"), F.inline(F.array(
            F.struct(F.lit("own_recall").alias("check"), F.col("attacker").alias("principal"), F.col("attacker_query").alias("query"), F.lit(None).cast("string").alias("asked_source")),
            F.struct(F.lit("control").alias("check"), F.col("target").alias("principal"), F.col("target_query").alias("query"), F.lit(None).cast("string").alias("asked_source")),
            F.struct(F.lit("foreign_search").alias("check"), F.col("attacker").alias("principal"), F.col("target_query").alias("query"), F.lit(None).cast("string").alias("asked_source")),
            F.struct(F.lit("all_sources").alias("check"), F.col("attacker").alias("principal"), F.col("target_query").alias("query"), F.lit(ALL_SOURCES).alias("asked_source")),
        )),
    ).withColumn("request_id", F.struct("pair_id", "check"))
    sources = grants.select(F.col("principal").alias("attacker"), "source_id", F.lit(True).alias("_own")).distinct()
    hit = search(cases, grants, pages).join(cases.select("request_id", "attacker"), "request_id").join(sources, ["attacker", "source_id"], "left")
    found = hit.groupBy("request_id").agg(F.count("*").alias("hits"), F.count_if(F.col("_own").isNull()).alias("foreign"))
    judged = cases.join(found, "request_id", "left")
    hits = F.coalesce("hits", F.lit(0).cast("bigint"))
    passed = F.when(F.col("check") == "own_recall", (hits > 0) & (F.col("foreign") == 0)).when(F.col("check") == "control", hits > 0).otherwise(hits == 0)
    searched = judged.select("pair_id", "check", hits.alias("hits"), F.coalesce(passed, F.lit(False)).alias("passed"))
    target_source = grants.select(F.col("principal").alias("target"), F.col("source_id").alias("asked_source")).distinct()
    reads = pairs.join(target_source, "target", "left").select(
        F.struct("pair_id", "asked_source").alias("request_id"), F.col("attacker").alias("principal"), F.col("target_slug").alias("slug"), "asked_source"
    )
    # one row a pair: every source of the target must refuse
    read = get_page(reads, grants, pages).groupBy(F.col("request_id.pair_id").alias("pair_id")).agg(
        F.count_if(F.col("outcome") == "ok").alias("hits"), F.bool_and(F.col("outcome") == "permission_denied").alias("passed")
    ).select("pair_id", F.lit("direct_read").alias("check"), "hits", "passed")
    return searched.unionByName(read)


def attack_totals(checks: DataFrame, keys: list[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
