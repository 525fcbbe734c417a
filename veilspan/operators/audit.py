"""Audit events: normalising, newest first, counts, last event per matter, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def numbers_only(counts_json: Column) -> Column:
    """Numeric members of a JSON object as ``map<string, double>``; booleans, strings and nested values drop out.

    Only the object's own members count, and of a repeated name the last one.
    """
    members = F.coalesce(F.map_entries(F.from_json(counts_json, "map<string,variant>")), F.from_json(F.lit("[]"), "array<struct<key:string,value:variant>>"))
    last = F.filter(members, lambda m, i: ~F.exists(F.slice(members, i + 2, F.size(members)), lambda later: later["key"] == m["key"]))
    kept = F.filter(last, lambda m: F.schema_of_variant(m["value"]).rlike(r"^(BIGINT|DECIMAL\(|DOUBLE|FLOAT)"))
    return F.map_from_entries(F.transform(kept, lambda m: F.struct(m["key"], F.try_variant_get(m["value"], "$", "double"))))


def normalise(events: DataFrame, now: Column | None = None) -> DataFrame:
    """``timestamp, kind, matter, summary, counts`` with defaults; ``counts`` comes in as JSON text."""
    now = F.current_timestamp() if now is None else now
    return events.select(
        F.coalesce("timestamp", now).alias("timestamp"),
        F.coalesce(F.nullif("kind", F.lit("")), F.lit("note")).alias("kind"),
        F.coalesce("matter", F.lit("")).alias("matter"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        numbers_only(F.col("counts")).alias("counts"),
    )


def recent(log: DataFrame, limit: int | str | None = 100, order: str = "seq") -> DataFrame:
    """Newest first by ingest order, not by timestamp; a bad limit means 100, a negative one 0."""
    try:
        n = max(0, int(limit))
    except (TypeError, ValueError):
        n = 100
    return log.orderBy(F.desc(order)).limit(n)


def filtered(log: DataFrame, kind: str | None = None, matter: str | None = None) -> DataFrame:
    out = log
    if kind:
        out = out.where(F.coalesce(F.nullif("kind", F.lit("")), F.lit("note")) == kind)
    if matter:
        out = out.where(F.col("matter") == matter)
    return out


def counts_by_kind(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce(F.nullif("kind", F.lit("")), F.lit("note")).alias("kind")).agg(F.count("*").alias("n"))


def last_per_matter(log: DataFrame, order: str = "seq") -> DataFrame:
    rest = [c for c in log.columns if c != "matter"]
    return log.groupBy("matter").agg(F.max_by(F.struct(*rest), order).alias("e")).select("matter", "e.*")


def backfill(log: DataFrame, cached: DataFrame, results: DataFrame, stems: dict[str, str], attack_stem: str) -> DataFrame:
    """Seed events from cached results (``stem, mtime, data``) and result rows, only while the log is empty.

    Whether it is empty is found when the result is read, by one row of the log at most.

    ``stems`` maps a result's stem to its event kind; the one named ``attack_stem`` tells passed checks instead of a matter.
    """
    kinds = F.create_map(*[F.lit(x) for kv in stems.items() for x in kv])
    field = lambda name: F.get_json_object("data", f"$.{name}")
    attack = F.col("stem") == attack_stem
    from_cache = cached.select(
        F.col("mtime").alias("timestamp"),
        F.coalesce(F.try_element_at(kinds, F.col("stem")), F.lit("note")).alias("kind"),
        F.when(attack, "").otherwise(F.coalesce(F.nullif(field("matter"), F.lit("")), field("target"), F.lit(""))).alias("matter"),
        F.when(
            attack,
            F.concat(F.lit("Access checks passed: "), F.coalesce(field("passed"), F.lit("?")), F.lit("/"), F.coalesce(field("total"), F.lit("?"))),
        ).otherwise(F.concat(F.lit("Taken over from "), "stem", F.lit(".json"))).alias("summary"),
        numbers_only(F.col("data")).alias("counts"),
    )
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    counts = F.map_filter(
        F.create_map(*[x for c in ("caught", "leaks", "false_alarms", "clean", "n") for x in (F.lit(c), F.col(c).cast("double"))]),
        lambda k, v: v.isNotNull(),
    )
    from_results = results.select(
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit("eval").alias("kind"), F.lit("").alias("matter"),
        F.concat(
            "detector", F.lit(" on "), "eval_set", F.lit(": caught "), said("caught"), F.lit("/"), said("leaks"), F.lit(", "),
            said("false_alarms"), F.lit(" false alarms (n="), said("n"), F.lit(")"),
        ).alias("summary"),
        counts.alias("counts"),
    )
    seeds = from_cache.unionByName(from_results)
    return seeds.join(F.broadcast(log.limit(1).select(F.lit(True).alias("_begun"))), F.lit(True), "left_anti")
