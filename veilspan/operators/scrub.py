"""Scrub: strip a matter's own facts and generic specifics so that a procedure can be reused.

Each replacement sees the output of the previous one, so the order is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P


def longest_first(literals: Column) -> Column:
    """Distinct non-empty literals, longest first (equal lengths in alphabetical order)."""
    keyed = F.transform(F.filter(F.array_distinct(literals), lambda s: s != ""), lambda s: F.struct((-F.length(s)).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def replace_literals(state: Column, literals: Column, placeholder: str) -> Column:
    """``struct<text, n>`` after replacing every literal, longest first, counting replacements."""
    return F.aggregate(
        longest_first(F.coalesce(literals, F.from_json(F.lit("[]"), "array<string>"))),
        state,
        lambda acc, s: F.struct(
            F.replace(acc["text"], s, F.lit(placeholder)).alias("text"),
            (acc["n"] + ((F.length(acc["text"]) - F.length(F.replace(acc["text"], s, F.lit("")))) / F.length(s)).cast("int")).alias("n"),
        ),
    )


def proper_tokens(literals: Column) -> Column:
    """Capitalised tokens of the facts that are neither all capitals nor a legal suffix."""
    found = F.flatten(F.transform(literals, lambda s: F.regexp_extract_all(s, F.lit(P.SCRUB_PROPER_TOKEN), F.lit(0))))
    return F.filter(F.array_distinct(found), lambda t: (t != F.upper(t)) & ~t.isin(*P.SCRUB_LEGAL_SUFFIXES))


PATTERN_STEPS = (
    ("exhibit", P.SCRUB_EXHIBIT, "the exhibit"),
    ("section", P.SCRUB_SECTION, "the relevant section"),
    ("date", P.SCRUB_DATE, "[date]"),
    ("amount", P.SCRUB_AMOUNT, "[amount]"),
    ("proper_noun", P.SCRUB_PROPER_NOUN, "the counterparty"),
)


def scrub_pattern(text: Column, step: str) -> tuple[Column, Column]:
    """Scrubbed text and number of replacements of one pattern step."""
    pattern, placeholder = next((p, r) for s, p, r in PATTERN_STEPS if s == step)
    return F.regexp_replace(text, pattern, placeholder), F.regexp_count(text, F.lit(pattern))


def tidy_articles(text: Column) -> Column:
    return F.regexp_replace(text, P.SCRUB_DOUBLE_ARTICLE, "the counterparty")


def scrub(requests: DataFrame, matters: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """``text, matter_id, practice`` requests to ``scrubbed, removed``.

    Requests for an unknown matter or practice come back with ``error`` set and
    no text, as a rejected request does.
    """
    sheet = matters.select("matter_id", "facts", F.lit(True).alias("_matter"))
    known = requests.join(sheet, "matter_id", "left")
    if policy is not None:
        known = known.join(policy.select("practice", F.lit(True).alias("_practice")).distinct(), "practice", "left")
    else:
        known = known.withColumn("_practice", F.lit(True))
    error = F.when(F.col("_practice").isNull(), F.concat(F.lit("unknown practice "), F.col("practice"))).when(
        F.col("_matter").isNull(), F.concat(F.lit("unknown matter_id "), F.col("matter_id"))
    )
    none = F.from_json(F.lit("[]"), "array<string>")

    def listed(*categories: str) -> Column:
        return F.concat(*[F.coalesce(F.try_element_at("facts", F.lit(c)), none) for c in categories])

    step = known.withColumn("error", error).withColumn(
        "_s", F.struct(F.when(F.col("error").isNull(), F.col("text")).alias("text"), F.lit(0).alias("n"))
    )
    step = step.withColumn("_s", replace_literals(F.col("_s"), listed("names", "orgs"), "the counterparty"))
    step = step.withColumn("_s", replace_literals(F.col("_s"), listed("amounts"), "[amount]"))
    step = step.withColumn("_s", replace_literals(F.col("_s"), listed("distinctive"), "[redacted detail]"))
    step = step.withColumn("_s", replace_literals(F.col("_s"), proper_tokens(listed("names", "orgs", "distinctive")), "Counterparty"))
    for name, _, _ in PATTERN_STEPS:
        text, n = scrub_pattern(F.col("_s.text"), name)
        step = step.withColumn("_s", F.struct(text.alias("text"), (F.col("_s.n") + n).alias("n")))
    keep = [c for c in requests.columns]
    return step.select(*keep, "error", tidy_articles(F.col("_s.text")).alias("scrubbed"), F.when(F.col("error").isNull(), F.col("_s.n")).alias("removed"))


def survives(scrubbed: Column, parts: Column) -> Column:
    """True when every part of a leaked detail is still in the scrubbed text, ignoring case."""
    return F.forall(parts, lambda p: F.lower(scrubbed).contains(F.lower(p)))


def procedure_steps(text: Column) -> Column:
    """Texts of the numbered steps ``1. ...``."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^([0-9]+)\.\s+(.+)$"), F.lit(2))
