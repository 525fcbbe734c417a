"""Whole texts inside other texts (hold-out contamination), by winnowed fingerprints.

A text that contains a literal of at least ``LEAST`` bytes holds all fingerprints of the literal (``winnow``). Of these the one that
is rarest among the texts is the literal's anchor: a phrase that every text shares (a template, a footer) never becomes a key
unless the literal holds nothing else. Texts and literals meet on anchors, and every pair is verified. Shorter literals are looked for in a
dictionary (``dictionary``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.dictionary import literal_matches, within_bound
from veilspan.operators.winnow import fingerprints
from veilspan.session import cut_lineage

#: Bytes that a literal must have to be found by fingerprints, and the longest window: the shortest such literal sets the window.
LEAST, MOST = 40, 400


def containing_pairs(texts: DataFrame, text_key: str, literals: DataFrame, literal_key: str, value: str, text: str = "text") -> DataFrame:
    """``text_key, literal_key`` wherever the (case-sensitive) literal occurs in the text."""
    # equal literals are one; they are told apart by a digest, so no whole text is a shuffle key
    told = literals.where(F.col(value) != "").select(F.col(literal_key), F.col(value).alias("needle"), F.sha2(F.col(value), 256).alias("digest"))
    unique = cut_lineage(told.groupBy("digest").agg(F.min(literal_key).alias("nid"), F.any_value("needle").alias("needle")), "literals")
    size = F.octet_length("needle")
    short, long = unique.where(size < LEAST).select("nid", "needle"), unique.where(size >= LEAST).select("nid", "needle")
    found = literal_matches(texts.select(text_key, F.col(text).alias("text")), text_key, short, "needle", False)
    pairs = found.select(text_key, "nid").distinct()
    shortest = long.agg(F.min(size)).first()[0]
    if shortest is not None:
        pairs = pairs.unionByName(_by_fingerprints(texts.select(text_key, F.col(text).alias("text")), text_key, long, min(shortest, MOST)))
    # every literal with the same value shares the match
    same = told.select(literal_key, "digest").join(unique.select("digest", "nid"), "digest").select(literal_key, "nid")
    return pairs.join(same, "nid").select(text_key, literal_key)


def _by_fingerprints(texts: DataFrame, text_key: str, literals: DataFrame, size: int) -> DataFrame:
    """``text_key, nid`` of literals (``nid, needle``) of at least ``size`` bytes; both tables are read in windows of that size."""
    own = cut_lineage(fingerprints(literals, "nid", "needle", size).distinct(), "literal-fingerprints")
    asked = own.select("h").distinct()
    # fingerprints that no literal has go where the texts are read, if the literals' are few enough to be sent there
    met = cut_lineage(fingerprints(texts, text_key, "text", size).join(within_bound(asked, own.count(), 0), "h", "left_semi"), "met")
    seen = met.groupBy("h").agg(F.count("*").alias("texts"))
    # a literal with a fingerprint that no text holds cannot occur anywhere
    rarest = own.join(seen, "h", "left").groupBy("nid").agg(
        F.min(F.coalesce("texts", F.lit(0))).alias("rarest"), F.min_by("h", F.struct(F.coalesce("texts", F.lit(0)), "h")).alias("h")
    )
    anchors = rarest.where("rarest > 0").select("h", "nid")
    candidates = cut_lineage(met.join(anchors, "h").select(text_key, "nid").distinct().join(literals, "nid"), "candidates")
    counted = candidates.agg(F.count("*"), F.sum(F.octet_length("needle"))).first()
    # few candidates go to the texts; many meet them by key
    both = texts.select(text_key, F.col("text").alias("_text")).join(within_bound(candidates, counted[0], counted[1] or 0), text_key)
    return both.where(F.col("_text").contains(F.col("needle"))).select(text_key, "nid").distinct()


def contaminated(rows: DataFrame, row_key: str, holdout: DataFrame, holdout_key: str, min_chars: int) -> DataFrame:
    """Keys of rows (``text``) that contain a held-out text or whose trimmed text lies inside one."""
    from veilspan.functions.text import strip

    held = holdout.select(holdout_key, strip(F.col("text")).alias("text")).where(F.length("text") >= min_chars)
    mine = rows.select(row_key, F.col("text"))
    forward = containing_pairs(mine, row_key, held.withColumnRenamed("text", "value"), holdout_key, "value").select(row_key)
    # a blank text lies inside every held-out text
    inside = mine.select(row_key, strip(F.col("text")).alias("value"))
    longest = held.agg(F.max(F.length("text"))).first()[0]
    if longest is None:
        return forward.distinct()
    # a row longer than every held-out text lies inside none
    backward = containing_pairs(held, holdout_key, inside.where(F.length("value") <= longest), row_key, "value").select(row_key)
    blank = inside.where("value = ''").select(row_key)
    return forward.unionByName(backward).unionByName(blank).distinct()
