"""Catalog, policy and review state of matters and their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspan.functions.spans import unnest
from veilspan.functions.text import strip


def merged_policy(base: DataFrame, override: DataFrame) -> DataFrame:
    """Override rows replace whole practices and may add new ones."""
    columns = [c for c in base.columns if c != "practice"]
    b = base.select("practice", F.struct(*columns).alias("b"))
    o = override.select("practice", F.struct(*columns).alias("o"))
    return b.join(o, "practice", "full").select("practice", F.coalesce("o", "b").alias("p")).select("practice", "p.*")


def policy_problems(policy: DataFrame) -> DataFrame:
    """Policy rows with ``reason``: null when the row may be saved."""
    def bad(column: str):
        return ~F.coalesce(F.forall(column, lambda i: F.coalesce(strip(i) != "", F.lit(False))), F.lit(False))

    reason = F.when(F.coalesce(strip(F.col("practice")) == "", F.lit(True)), "practice name must be a non-empty string")
    for column in ("may_compound", "never_compounds"):
        reason = reason.when(F.col(column).isNull(), f"missing {column}").when(bad(column), f"{column} must be a list of non-empty strings")
    return policy.withColumn("reason", reason)


def catalog_documents(matters: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per document with its matter's entry, matters without documents kept.

    A nested map per matter would put a large tenant into one row; sorted by
    matter this table streams to whoever needs the nested form.
    """
    return matters.join(documents, "matter_id", "left")


def review_state(matters: DataFrame, documents: DataFrame, entries: DataFrame) -> DataFrame:
    """``total, added, flagged, state`` per matter: flagged, todo, done or partial."""
    total = documents.groupBy("matter_id").agg(F.count("*").alias("total"))
    seen = entries.groupBy("matter_id").agg(F.count_if(~F.col("flagged")).alias("added"), F.count_if(F.col("flagged")).alias("flagged"))
    zero = F.lit(0).cast("bigint")
    joined = matters.join(total, "matter_id", "left").join(seen, "matter_id", "left").select(
        *matters.columns, F.coalesce("total", zero).alias("total"), F.coalesce("added", zero).alias("added"), F.coalesce("flagged", zero).alias("flagged")
    )
    state = F.when(F.col("flagged") > 0, "flagged").when(F.col("added") == 0, "todo").when(F.col("added") >= F.col("total"), "done").otherwise("partial")
    return joined.withColumn("state", state)


def next_matter(states: DataFrame) -> DataFrame:
    """The first matter to work on: flagged before partial before todo, then catalog order."""
    order = F.array(*[F.lit(s) for s in ("flagged", "partial", "todo")])
    return states.withColumn("place", F.array_position(order, F.col("state"))).where("place > 0").orderBy("place", "matter_ord").limit(1).drop("place")


def progress(states: DataFrame) -> DataFrame:
    total = states.agg(F.sum("total").alias("total"), F.sum("added").alias("added"), F.sum("flagged").alias("flagged"))
    return total.withColumn("pct", F.coalesce(F.floor(F.try_divide(F.col("added"), F.col("total")) * 100 + 0.5), F.lit(0).cast("bigint")))


def last_writes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row written per key, kept as a whole; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return latest.select(*keys, "last.*").select(*rows.columns)


def worklist(documents: DataFrame, entries: DataFrame, practice: str) -> DataFrame:
    """Documents of one practice as idle rows; a review entry with the same id takes over, other entries are added.

    ``documents``: ``matter_id, doc_name, client, practice, beneficiary, text``;
    ``entries``: ``id, title, document, client, matter_id, text, removed, verdict, judge``.
    """
    label = F.replace(F.regexp_replace("doc_name", r"\.md$", ""), F.lit("-"), F.lit(" "))
    docs = documents.where(F.col("practice") == practice).select(
        F.concat_ws("/", "matter_id", "doc_name").alias("id"),
        F.concat(F.upper(F.substring(label, 1, 1)), label.substr(F.lit(2), F.length(label))).alias("label"),
        "client", F.col("matter_id").alias("doc_matter"), "beneficiary", F.col("text").alias("doc_text"),
    )
    done = entries.where(F.coalesce("text", F.lit("")) != "").select(
        "id", F.coalesce(F.nullif("title", F.lit("")), F.nullif("document", F.lit("")), F.lit("Review exhibit")).alias("e_label"),
        F.col("client").alias("e_client"), "matter_id", F.col("text").alias("e_text"), F.coalesce("removed", F.lit(0)).alias("e_removed"), "verdict", "judge", F.lit(True).alias("reviewed"),
    )
    both = docs.join(done, "id", "full")
    reviewed = F.coalesce("reviewed", F.lit(False))
    return both.select(
        "id", F.coalesce("label", "e_label").alias("label"), F.coalesce("client", "e_client").alias("petitioner"),
        F.coalesce("doc_matter", "matter_id").alias("matter_id"), "beneficiary", F.coalesce("doc_text", "e_text").alias("text"),
        F.when(reviewed, "review").otherwise("matter").alias("source"), F.when(reviewed, "done").otherwise("idle").alias("state"),
        F.col("e_text").alias("redacted"), F.col("e_removed").alias("removed"), F.col("verdict").alias("residual_verdict"), "judge",
    )


def open_flag(verdict):
    return F.coalesce(verdict == "leak", F.lit(False))


def exportable(docs: DataFrame, include_unverified: bool = False) -> DataFrame:
    """Finished documents without an open leak flag that were judged (or are let in unjudged)."""
    judged = F.col("residual_verdict").isNotNull() | F.lit(include_unverified)
    return docs.where((F.col("state") == "done") & ~open_flag(F.col("residual_verdict")) & judged)


def readiness(docs: DataFrame, include_unverified: bool = False) -> DataFrame:
    """Counts of the readiness panel over ``state, removed, spans, residual_verdict, judge``."""
    done, flag = F.col("state") == "done", open_flag(F.col("residual_verdict"))
    unverified = done & F.col("residual_verdict").isNull()
    summed = docs.agg(
        F.count("*").alias("docs"), F.count_if(done).alias("done"),
        F.coalesce(F.sum(F.when(done, F.col("removed"))), F.lit(0)).cast("bigint").alias("removed"),
        F.count_if(done & flag).alias("flags"),
        F.count_if(done & F.exists("spans", lambda s: s["kind"] == "judge_flag")).alias("redacted"),
        F.count_if(done & F.col("residual_verdict").isNotNull() & ~flag).alias("cleared"),
        F.count_if(unverified).alias("unverified"), F.count_if(F.col("state") == "error").alias("failed"),
    )
    ready = F.col("cleared") + (F.col("unverified") if include_unverified else F.lit(0))
    held = F.col("flags") + F.col("failed") + (F.lit(0) if include_unverified else F.col("unverified"))
    return summed.withColumn("todo", F.col("docs") - F.col("done") - F.col("failed")).withColumn("ready", ready).withColumn("held", held)


def kinds_ranked(docs: DataFrame) -> DataFrame:
    """Removed spans by kind, most frequent first."""
    return unnest(docs.where(F.col("state") == "done"), "spans.kind", "kind").groupBy("kind").agg(
        F.count("*").alias("n")
    ).orderBy(F.desc("n"), "kind")
