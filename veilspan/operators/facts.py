"""Known facts of matters: the fact table, its scans over texts and its short forms.

Fact tables have ``matter_id, matter_ord, category, ord, value``; ``matter_ord``
is the place of the matter in the catalog, ``ord`` the place in its list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions import spans as S
from veilspan.functions.spans import unnest
from veilspan.operators.dictionary import FEW_PIECES, apart, literal_matches, within_bound
from veilspan.operators.sieve import sieve
from veilspan.session import cut_lineage

CATEGORY_ORDER = tuple(P.CATEGORY_KIND)


def fact_table(matters: DataFrame) -> DataFrame:
    """Explode ``matter_id, matter_ord, facts map<string, array<string>>``."""
    return (
        matters.select("matter_id", "matter_ord", F.explode("facts").alias("category", "values"))
        .select("matter_id", "matter_ord", "category", F.posexplode("values").alias("ord", "value"))
        .where(F.col("value") != "")
    )


def size_of(facts: DataFrame) -> tuple[int, int]:
    """Rows of a fact table and bytes of its values: what a table made of it has at most."""
    told = facts.agg(F.count("*"), F.sum(F.octet_length("value"))).first()
    return told[0], told[1] or 0


def kind_of(category: Column) -> Column:
    """Placeholder kind of a fact category; unknown categories lose a plural s."""
    known = F.create_map(*[F.lit(x) for kv in P.CATEGORY_KIND.items() for x in kv])
    return F.coalesce(F.try_element_at(known, category), F.regexp_replace(category, "(?<=.)s$", ""))


def category_rank(category: Column) -> Column:
    ranks = F.array(*[F.lit(c) for c in CATEGORY_ORDER])
    place = F.array_position(ranks, category)
    return F.when(place > 0, place).otherwise(len(CATEGORY_ORDER) + 1)


def fact_values(facts: DataFrame) -> DataFrame:
    """Each distinct value once, with the kind and place of its first owner."""
    first = F.min(F.struct("matter_ord", category_rank(F.col("category")).alias("rank"), "ord", "category", "matter_id"))
    return facts.groupBy("value").agg(first.alias("f")).select(
        "value", kind_of(F.col("f.category")).alias("kind"), "f.matter_ord", "f.rank", "f.ord", "f.matter_id"
    )


def own_fact_values(facts: DataFrame) -> DataFrame:
    """Each matter's own values once, with the kind under which that matter lists them first."""
    first = F.min(F.struct(category_rank(F.col("category")).alias("rank"), "ord", "category"))
    return facts.groupBy("matter_id", "value").agg(first.alias("f")).select(
        "matter_id", "value", kind_of(F.col("f.category")).alias("own_kind"), F.col("f.rank").alias("own_rank"), F.col("f.ord").alias("own_ord")
    )


def fact_hits(texts: DataFrame, text_key: str, facts: DataFrame, text: str = "text") -> DataFrame:
    """Case-sensitive occurrences of every matter's facts: ``start, end, kind, entity``.

    A matter's own listing decides the kind of a value that several matters list.
    ``texts`` may have ``matter_id``.
    """
    # the matter rides along with the key, so texts are read once
    carried = [text_key, "matter_id"] if "matter_id" in texts.columns else [text_key]
    keyed = texts.select(F.struct(*carried).alias("_at"), F.col(text).alias("_text"))
    hits = literal_matches(keyed, "_at", fact_values(facts), "value", ignore_case=False, text="_text")
    hits = hits.select("_at.*", "start", "end", "kind", F.col("value").alias("entity"))
    if len(carried) == 1:
        return hits
    own = own_fact_values(facts).select("matter_id", F.col("value").alias("entity"), "own_kind")
    return hits.join(apart(own, *size_of(facts)), ["matter_id", "entity"], "left").select(text_key, "start", "end", F.coalesce("own_kind", "kind").alias("kind"), "entity")


def partial_forms(value: Column, kind: Column) -> Column:
    """Short forms: first and last token of a name, every distinctive token of an org."""
    trimmed = F.transform(F.split(value, rf"{P.SPACE}+", -1), lambda t: F.regexp_replace(t, r"^[.,&()']+|[.,&()']+$", ""))
    titles, common = F.array(*[F.lit(t) for t in P.PARTIAL_TITLES]), F.array(*[F.lit(c) for c in P.PARTIAL_COMMON])
    tokens = F.filter(trimmed, lambda t: (t != "") & ~F.array_contains(titles, F.lower(t)))
    none = F.from_json(F.lit("[]"), "array<string>")
    picks = F.when(F.size(tokens) < 2, none).when(kind == "org", tokens).when(
        kind == "name", F.array(F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(-1)))
    ).otherwise(none)
    return F.filter(picks, lambda t: (F.length(t) >= 3) & t.rlike(r"^\p{Lu}") & ~F.array_contains(common, F.lower(t)))


def partial_table(facts: DataFrame) -> DataFrame:
    """Each short form with its first claimant over the whole catalog: ``part, kind, entity``."""
    values = fact_values(facts)
    parts = unnest(values, partial_forms(F.col("value"), F.col("kind")), "part", "*", at="part_ord")
    first = F.min(F.struct("matter_ord", "rank", "ord", "part_ord", "kind", "value"))
    return parts.groupBy("part").agg(first.alias("f")).select("part", F.col("f.kind").alias("kind"), F.col("f.value").alias("entity"))


def own_partial_table(facts: DataFrame) -> DataFrame:
    """Each matter's claims on short forms; they come before the catalog's."""
    own = own_fact_values(facts)
    parts = unnest(own, partial_forms(F.col("value"), F.col("own_kind")), "part", "*", at="part_ord")
    first = F.min(F.struct("own_rank", "own_ord", "part_ord", "own_kind", "value"))
    return parts.groupBy("matter_id", "part").agg(first.alias("f")).select(
        "matter_id", "part", F.col("f.own_kind").alias("own_kind"), F.col("f.value").alias("own_entity")
    )


def partial_hits(texts: DataFrame, text_key: str, facts: DataFrame, text: str = "text") -> DataFrame:
    """Whole-word occurrences of short forms, carrying the full entity they stand for.

    Texts are cut into alternating word and other runs; a short form meets them
    on its first word run and is verified against the runs that follow.
    """
    edge = rf"(?<={P.WORD})(?!{P.WORD})|(?<!{P.WORD})(?={P.WORD})"
    parts = cut_lineage(partial_table(facts).withColumn("lead", F.regexp_extract("part", rf"^{P.WORD}+", 0)), "short-forms")
    sizes = parts.agg(F.max(F.size(F.split("part", edge, -1))), F.count("*"), F.sum(F.octet_length("part") + F.octet_length("entity"))).first()
    reach = sizes[0] or 1
    passes = sieve(parts.select(F.xxhash64("lead").alias("key")), "key", sizes[1])
    carried = [text_key, "matter_id"] if "matter_id" in texts.columns else [text_key]

    def starts_of(runs: Column) -> Column:
        return S.bind(S.running(F.transform(runs, F.length)), lambda ends: F.zip_with(runs, ends, lambda r, end: end - F.length(r)))

    cut = texts.select(*carried, S.marked(F.col(text), edge, S.MARK).alias("_marked")).select("*", F.split("_marked", S.MARK, -1).alias("_runs"))
    placed = cut.select("*", F.when(F.size("_runs") > FEW_PIECES, starts_of(F.col("_runs"))).alias("_starts")).select("*", F.posexplode("_runs").alias("_i", "lead"))
    # runs drop out one by one in generated code; the context of one is taken only if a short form may begin with it
    kept = placed.where(passes(F.xxhash64("lead")) & F.col("lead").rlike(P.WORD))
    start = F.when(F.col("_starts").isNotNull(), F.get("_starts", F.col("_i"))).when(F.col("_i") == 0, 0).otherwise(
        F.length(F.call_function("substring_index", F.col("_marked"), F.lit(S.MARK), F.col("_i"))) - (F.col("_i") - 1)
    )
    context = F.array_join(F.slice("_runs", F.col("_i") + 1, F.lit(reach + 1)), "")
    rows = kept.select(*carried, start.alias("start"), "lead", context.alias("context"))
    after = F.col("context").substr(F.length("part") + 1, F.lit(1))
    ends_in_word = F.col("part").rlike(rf"{P.WORD}$")
    met = rows.join(within_bound(parts, sizes[1], sizes[2] or 0), "lead").where(
        F.col("context").startswith(F.col("part")) & (ends_in_word != after.rlike(P.WORD))
    )
    found = met.select(*carried, "start", (F.col("start") + F.length("part")).alias("end"), "kind", "entity", "part")
    if "matter_id" not in texts.columns:
        return found.select(text_key, "start", "end", "kind", "entity")
    own = own_partial_table(facts)
    return found.join(apart(own, *size_of(facts)), ["matter_id", "part"], "left").select(
        text_key, "start", "end", F.coalesce("own_kind", "kind").alias("kind"), F.coalesce("own_entity", "entity").alias("entity")
    )
