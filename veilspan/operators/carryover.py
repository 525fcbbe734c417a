"""Copied phrases: word 6-grams of a draft that exactly one other matter's corpus holds.

Grams travel as a 128-bit key. Every aggregation combines on the map side
before it shuffles and the first one is spread over (gram, matter), so a phrase
that a third of all documents share (a footer) never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import unnest
from veilspan.functions.text import gram_key, word_ngrams, words
from veilspan.operators.dictionary import within_bound
from veilspan.operators.sieve import sieve
from veilspan.session import cut_lineage

KEY = ["h1", "h2"]
#: Texts of a part whose grams are combined where they are cut, which takes no spill at a few hundred words a text.
PART_ROWS = 4_000


def dealt(corpus: DataFrame) -> DataFrame:
    """A corpus (``doc_id, text``) in parts of about ``PART_ROWS`` texts, numbered ``part``, however its files are cut.

    Grams weigh some twenty times the text: what the parts cost in shuffled text they save many times over in grams that
    would be spilled while they are combined.
    """
    parts = max(1, -(-corpus.count() // PART_ROWS))
    return corpus.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartitionById(parts, "part")


def gram_rows(texts: DataFrame, keys: list[str], n: int = P.CARRY_N, token: str = P.CARRY_TOKEN, text: str = "text", positions: bool = False) -> DataFrame:
    """``keys, h1, h2`` per distinct gram of a text, or per occurrence with ``i`` when positions are asked for."""
    tokens = texts.select(*keys, words(F.col(text), token).alias("tokens"))
    grams = word_ngrams(F.col("tokens"), n)
    if positions:
        return unnest(tokens, F.transform(grams, gram_key), "g", *keys, at="i").select(*keys, "i", "g.h1", "g.h2")
    return unnest(tokens, F.transform(F.array_distinct(grams), gram_key), "g", *keys).select(*keys, "g.h1", "g.h2")


def gram_owners(corpus: DataFrame, n: int = P.CARRY_N, token: str = P.CARRY_TOKEN) -> DataFrame:
    """Grams of a corpus (``matter_id, text``) with their owner count and, if single, the owner.

    Write it as a table once and reuse it for every check.
    """
    grams = gram_rows(corpus, ["matter_id"], n, token)
    per_matter = grams.groupBy(*KEY, "matter_id").agg(F.count("*").alias("texts"))
    return per_matter.groupBy(*KEY).agg(F.count("*").alias("owners"), F.min("matter_id").alias("owner"))


def single_owner(owners: DataFrame) -> DataFrame:
    """Grams that exactly one matter holds; boilerplate of two or more drops out here."""
    return owners.where(F.col("owners") == 1).select(*KEY, "owner")


def carryover_grams(drafts: DataFrame, owners: DataFrame, n: int = P.CARRY_N, token: str = P.CARRY_TOKEN) -> DataFrame:
    """Occurrences in drafts (``draft_id, matter_id, text``) of grams that one other matter owns.

    A gram of the draft's own corpus has that matter among its owners, so it is
    either shared (dropped) or owned by the draft's matter (dropped here).
    """
    rows = gram_rows(drafts, ["draft_id", "matter_id"], n, token, positions=True)
    return rows.join(single_owner(owners), KEY).where(
        F.col("matter_id").isNull() | (F.col("matter_id") != F.col("owner"))
    ).select("draft_id", "matter_id", "i", "owner")


def merge_grams(hits: DataFrame, n: int = P.CARRY_N) -> DataFrame:
    """Consecutive overlapping windows of one owner are one phrase: tokens ``first`` to ``last``.

    Tokens are separated by at least one character, so windows overlap in the
    text exactly when they share a token.
    """
    order = W.partitionBy("draft_id").orderBy("i")
    new = (F.lag("owner").over(order) != F.col("owner")) | (F.col("i") - F.lag("i").over(order) >= n)
    island = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return hits.withColumn("island", island).groupBy("draft_id", "matter_id", "island", "owner").agg(
        F.min("i").alias("first"), (F.max("i") + (n - 1)).alias("last"), F.count("*").alias("grams")
    ).drop("island")


def phrase_texts(phrases: DataFrame, drafts: DataFrame, token: str = P.CARRY_TOKEN) -> DataFrame:
    """Add ``evidence``: the draft's own characters from the first to the last token of a phrase.

    A draft meets its phrases as one array, so only drafts with a hit are cut into tokens, and once each.
    """
    rest = [c for c in phrases.columns if c != "draft_id"]
    told = phrases.groupBy("draft_id").agg(F.collect_list(F.struct(*rest)).alias("told"))  # as many as the draft holds
    met = drafts.select("draft_id", "text").join(told, "draft_id").select(
        "draft_id", "told", F.split("text", token, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(token), F.lit(0)).alias("tokens")
    )

    def said(first: Column, last: Column) -> Column:
        wide = F.zip_with(
            F.slice("tokens", first + 2, last - first), F.slice("gaps", first + 2, last - first), lambda t, g: F.concat(g, t)
        )
        return F.concat(F.element_at("tokens", first + 1), F.array_join(wide, ""))

    shown = F.transform("told", lambda p: F.struct(*[p[c].alias(c) for c in rest], said(p["first"], p["last"]).alias("evidence")))
    return met.select("draft_id", F.inline(shown))


def carryover_hits(drafts: DataFrame, corpus: DataFrame, n: int = P.CARRY_N) -> DataFrame:
    """Merged phrases with their evidence: ``draft_id, matter_id, owner, first, last, grams, evidence``."""
    return phrase_texts(merge_grams(carryover_grams(drafts, gram_owners(corpus, n), n), n), drafts)


# --- every document as a draft of its own matter ---------------------------


def left_out_grams(corpus: DataFrame, n: int = P.CARRY_N, token: str = P.CARRY_TOKEN) -> DataFrame:
    """Each document checked against all others: ``draft_id, matter_id, owner, h1, h2``.

    Leaving a document out, a gram of it counts when no other document of its
    matter holds it and exactly one other matter does: two matters hold the gram
    and in one of them a single document does. Grams are combined in their part
    and shuffled once; a gram of three matters in one part can be no hit, and
    three of its matters tell so, so that a part sends no gram more often. Where
    they meet, grams of one matter drop out before the others are compared.
    """
    grams = gram_rows(dealt(corpus), ["part", "doc_id", "matter_id"], n, token)
    spans = [F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")]
    told = F.row_number().over(W.partitionBy("part", *KEY).orderBy("matter_id")) <= 3
    sent = grams.groupBy("part", *KEY, "matter_id").agg(*spans).withColumn("told", told).where("told").select(*KEY, "matter_id", "d0", "d1").repartition(*KEY)
    matter, gram = F.xxhash64("matter_id"), W.partitionBy(*KEY)
    shared = sent.withColumn("several", F.min(matter).over(gram) != F.max(matter).over(gram)).where("several")
    per_matter = shared.groupBy(*KEY, "matter_id").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    side = F.struct("matter_id", "d0", "d1")
    pairs = per_matter.groupBy(*KEY).agg(F.count("*").alias("owners"), F.min(side).alias("a"), F.max(side).alias("b")).where(F.col("owners") == 2)
    sides = F.array(
        F.struct(F.col("a").alias("mine"), F.col("b.matter_id").alias("owner")),
        F.struct(F.col("b").alias("mine"), F.col("a.matter_id").alias("owner")),
    )
    return (
        pairs.select(*KEY, F.inline(sides))
        .where(F.col("mine.d0") == F.col("mine.d1"))
        .select(F.col("mine.d0").alias("draft_id"), F.col("mine.matter_id").alias("matter_id"), "owner", *KEY)
    )


def left_out_phrases(corpus: DataFrame, n: int = P.CARRY_N, token: str = P.CARRY_TOKEN) -> DataFrame:
    """Merged phrases of ``left_out_grams``.

    The hits are written once, counted, and meet their document as one array. Its positions are read again, sifted there by a
    Bloom filter of (document, gram), and meet the hits in the same task, so that texts are shuffled and no position is.
    """
    found = left_out_grams(corpus, n, token).select("draft_id", "owner", *KEY)
    hits = cut_lineage(found.withColumn("at", F.xxhash64("draft_id", *KEY)), "left-out-grams")
    passes = sieve(hits.select("at"), "at", hits.count())
    asked = hits.groupBy("draft_id").agg(F.collect_list(F.struct("owner", *KEY)).alias("asked"))  # as many as the document holds
    drafts = corpus.select(F.col("doc_id").alias("draft_id"), "matter_id", "text").join(asked, "draft_id")
    tokens = drafts.select("draft_id", "matter_id", "asked", words(F.col("text"), token).alias("tokens"))
    nobody = F.lit(None).cast(f"struct<owner:{corpus.schema['matter_id'].dataType.simpleString()}>")  # an owner may be null, in a struct that is not
    placed = F.transform(F.transform(word_ngrams(F.col("tokens"), n), gram_key), lambda g, i: F.struct(i.alias("i"), nobody.alias("owner"), g["h1"].alias("h1"), g["h2"].alias("h2")))
    sifted = F.filter(placed, lambda g: passes(F.xxhash64("draft_id", g["h1"], g["h2"])))
    told = F.transform("asked", lambda h: F.struct(F.lit(None).cast("int").alias("i"), F.struct(h["owner"].alias("owner")).alias("owner"), h["h1"].alias("h1"), h["h2"].alias("h2")))
    rows = unnest(tokens, F.concat(told, sifted), "g", "draft_id", "matter_id").select("draft_id", "matter_id", "g.*")
    met = rows.groupBy("draft_id", "matter_id", *KEY).agg(F.collect_list("i").alias("i"), F.collect_set("owner").alias("owners")).where((F.size("owners") > 0) & (F.size("i") > 0))
    each = met.select("draft_id", "matter_id", F.explode("i").alias("i"), "owners")
    return merge_grams(each.select("draft_id", "matter_id", "i", F.explode("owners").alias("o")).select("draft_id", "matter_id", "i", "o.owner"), n)


def ngram_overlap(evals: DataFrame, eval_key: str, training: DataFrame, n: int = P.OVERLAP_N) -> DataFrame:
    """Share of each eval text's distinct n-grams that occur in training: ``eval_key, grams, seen, share``."""
    mine = gram_rows(evals, [eval_key], n)
    # training grams that no eval text has are dropped where they are read, if the eval grams are few enough to be sent there
    asked = mine.select(*KEY).distinct()
    met = gram_rows(training, [], n).join(within_bound(asked, asked.count(), 0), KEY, "left_semi")
    known = met.distinct().withColumn("hit", F.lit(1))
    return mine.join(known, KEY, "left").groupBy(eval_key).agg(
        F.count("*").alias("grams"), F.count("hit").alias("seen"), (F.count("hit") / F.count("*")).alias("share")
    )
