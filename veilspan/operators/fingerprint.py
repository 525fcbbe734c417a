"""Facts of other matters in a draft: names and orgs as literals, amounts by written form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions.amounts import FORMS, amount_value, mentions, variants
from veilspan.functions.spans import unnest
from veilspan.operators.dictionary import literal_matches
from veilspan.operators.facts import category_rank


def first_owners(facts: DataFrame) -> DataFrame:
    """Each lower-cased name or org once per category, with its first owner.

    A span is credited to the first matter that lists it, so later owners of a
    shared value cannot add anything: a value listed by a third of all matters
    is still one row.
    """
    named = facts.where(F.col("category").isin("names", "orgs")).withColumn("folded", F.lower("value"))
    first = F.min(F.struct("matter_ord", "ord", "matter_id"))
    return named.groupBy("category", "folded").agg(first.alias("f")).select(
        "category", "folded", "f.matter_ord", "f.ord", F.col("f.matter_id").alias("owner")
    )


def first_amount_owners(facts: DataFrame) -> DataFrame:
    """Written variants of each amount value, with the value's first owner: ``form, key``."""
    amounts = facts.where(F.col("category") == "amounts").withColumn("value_n", amount_value(F.col("value")))
    first = F.min(F.struct("matter_ord", "ord", "matter_id", "value"))
    unique = amounts.where(F.col("value_n").isNotNull()).groupBy("value_n").agg(first.alias("f"))
    return unnest(unique, variants(F.col("f.value")), "v", "value_n", "f.matter_ord", "f.ord", F.col("f.matter_id").alias("owner")).select("value_n", "matter_ord", "ord", "owner", "v.form", "v.key")


def name_matches(drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """Case-insensitive substring matches of names and orgs, before own facts are subtracted."""
    keyed = drafts.select(F.struct("draft_id", "matter_id").alias("_at"), "text")
    hits = literal_matches(keyed, "_at", first_owners(facts), "folded", ignore_case=True)
    return hits.select("_at.*", "category", F.col("folded").alias("value_key"), "matter_ord", "ord", "owner",
                       F.lit(0).alias("form_ord"), "start", "end", F.col("found").alias("evidence"))


def amount_matches(drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """Amounts that a written form in the draft stands for, before own amounts are subtracted."""
    told = F.transform(mentions(F.col("text")), lambda m: F.struct(
        m["form"].alias("form"), m["key"].alias("key"), m["start"].alias("start"), m["end"].alias("end"),
        F.col("text").substr(m["start"] + 1, m["end"] - m["start"]).alias("evidence"),
    ))
    seen = unnest(drafts, told, "m", "draft_id", "matter_id").select("draft_id", "matter_id", "m.*")
    ranks = F.array(*[F.lit(f) for f in FORMS])
    return seen.join(first_amount_owners(facts), ["form", "key"]).select(
        "draft_id", "matter_id", F.lit("amounts").alias("category"), F.col("value_n").cast("string").alias("value_key"), "matter_ord", "ord", "owner",
        F.array_position(ranks, F.col("form")).cast("int").alias("form_ord"), "start", "end", "evidence",
    )


def own_keys(facts: DataFrame) -> DataFrame:
    """What a matter may say itself: names and orgs by lower case, amounts by value."""
    key = F.when(F.col("category") == "amounts", amount_value(F.col("value")).cast("string")).otherwise(F.lower("value"))
    return (
        facts.where(F.col("category").isin("names", "orgs", "amounts"))
        .select("matter_id", "category", key.alias("value_key"))
        .where(F.col("value_key").isNotNull())
        .distinct()
    )


def without_own(matches: DataFrame, facts: DataFrame) -> DataFrame:
    return matches.join(own_keys(facts), ["matter_id", "category", "value_key"], "left_anti")


def fingerprint_hits(drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """``draft_id, matter_id, owner, category, start, end, evidence``; one row per span.

    ``drafts``: ``draft_id, matter_id, text``.
    """
    every = name_matches(drafts, facts).unionByName(amount_matches(drafts, facts))
    foreign = without_own(every, facts)
    order = W.partitionBy("draft_id", "start", "end").orderBy("matter_ord", category_rank(F.col("category")), "ord", "form_ord")
    return (
        foreign.withColumn("place", F.row_number().over(order))
        .where(F.col("place") == 1)
        .select("draft_id", "matter_id", "owner", "category", "start", "end", "evidence")
    )


def facts_of_others(texts: DataFrame, text_key: str, facts: DataFrame) -> DataFrame:
    """Facts of other matters found verbatim: ``text_key, value, kind`` per owning matter.

    Counts owners instead of listing them: ``n_owners`` other matters list the value.
    """
    values = facts.groupBy("value", "category").agg(F.countDistinct("matter_id").alias("owners"))
    keyed = texts.select(F.struct(text_key, "matter_id").alias("_at"), "text")  # the matter rides with the key
    found = literal_matches(keyed, "_at", values.select("value").distinct(), "value", ignore_case=False)
    present = found.select("_at.*", "value").distinct()
    own = facts.select("matter_id", "value", "category", F.lit(1).alias("mine")).distinct()
    counted = present.join(values, "value").join(own, ["matter_id", "value", "category"], "left")
    return counted.select(
        text_key, "value", F.col("category").alias("kind"), (F.col("owners") - F.coalesce("mine", F.lit(0))).alias("n_owners")
    ).where(F.col("n_owners") > 0)
