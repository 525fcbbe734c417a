"""Identifier detectors: text to ``array<struct<start, end, kind>>``."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import SPAN_DDL, merge_overlapping, regex_spans, resolve_by_priority, scan, span, unnest

SIMPLE_KINDS = ("email", "url", "ssn", "phone", "date", "amount", "address", "a_number", "receipt", "org")


def kind_spans(text: Column, kind: str) -> Column:
    """All matches of one kind; patterns of a kind are listed one after the other."""
    if kind == "passport":
        return passport_spans(text)
    if kind == "name":
        return name_spans(text)
    return F.concat(*[regex_spans(text, p, kind) for p in P.IDENTIFIER_PATTERNS[kind]])


def passport_spans(text: Column) -> Column:
    """First 6-9 character token with a digit that starts within reach of the word "passport"."""
    contexts = scan(
        text, P.IDENTIFIER_PATTERNS["passport"][0],
        lambda at, m, gap: F.struct((at + F.length(m)).alias("end")), "struct<end:int>",
    )

    def first_token(context: Column) -> Column:
        window = text.substr(context["end"] + 1, F.lit(P.PASSPORT_REACH + P.PASSPORT_TOKEN_MAX))
        tokens = scan(
            window, P.PASSPORT_TOKEN,
            lambda at, m, gap: F.struct(at.alias("at"), m.alias("token")), "struct<at:int,token:string>",
        )
        usable = F.filter(tokens, lambda t: (t["at"] <= P.PASSPORT_REACH) & t["token"].rlike("[0-9]"))
        return F.transform(
            F.slice(usable, 1, 1),
            lambda t: span(context["end"] + t["at"], context["end"] + t["at"] + F.length(t["token"]), "passport"),
        )

    return F.flatten(F.transform(contexts, first_token))


def titled_names(text: Column) -> Column:
    return regex_spans(text, P.TITLED_NAME, "name")


def salutation_names(text: Column) -> Column:
    def inner(at: Column, match: Column, gap: Column) -> Column:
        start = at + F.length(F.regexp_extract(match, P.SALUTATION_LEAD, 0))
        return span(start, start + F.length(F.regexp_extract(match, P.SALUTATION, 1)), "name")

    return scan(text, P.SALUTATION, inner, SPAN_DDL)


def bare_names(text: Column) -> Column:
    """Capitalised runs without a stopword that do not open a sentence."""
    stop = F.array(*[F.lit(w) for w in P.NAME_STOPWORDS])
    ddl = "struct<start:int,end:int,keep:boolean>"

    def judged(at: Column, match: Column, gap: Column) -> Column:
        before = F.regexp_replace(gap, rf"{P.SPACE}+$", "")
        # a blank gap is the text start, or follows a previous run, which ends in a letter
        opens = F.when(before == "", at == F.length(gap)).otherwise(before.rlike(r"[.!?]$"))
        clean = ~F.arrays_overlap(F.split(match, rf"{P.SPACE}+", -1), stop)
        return F.struct(at.alias("start"), (at + F.length(match)).alias("end"), (clean & ~opens).alias("keep"))

    runs = scan(text, P.BARE_NAME, judged, ddl)
    return F.transform(F.filter(runs, lambda r: r["keep"]), lambda r: span(r["start"], r["end"], "name"))


def name_spans(text: Column) -> Column:
    return F.concat(titled_names(text), salutation_names(text), bare_names(text))


def candidate_spans(text: Column) -> Column:
    """Every detector's spans, still overlapping."""
    return F.concat(*[kind_spans(text, k) for k in (*SIMPLE_KINDS[:-1], "passport", "org", "name")])


def identifier_spans(text: Column) -> Column:
    """Disjoint identifier spans, sorted by start."""
    return resolve_by_priority(candidate_spans(text))


def marker_hits(text: Column, markers: list[str]) -> Column:
    """Literal markers (lower-case) that occur in the text, ignoring case."""
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.lower(text).contains(m))


def spans_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per identifier: ``key, start, end, kind, span_text``."""
    found = df.select(key, text, identifier_spans(F.col(text)).alias("spans"))
    return unnest(found, "spans", "s", key, text).select(
        key, "s.start", "s.end", "s.kind", F.col(text).substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("span_text")
    )


# --- ensemble ---------------------------------------------------------------

_REGISTRY: dict = {}
_LOG = logging.getLogger(__name__)


def register_detector(name: str, fn) -> None:
    """``fn(df, key, text) -> DataFrame[key, start, end, kind]``; later registrations replace earlier ones."""
    _REGISTRY[name] = fn


def detectors() -> dict:
    return dict(_REGISTRY)


def _rules(df: DataFrame, key: str, text: str) -> DataFrame:
    return spans_table(df, key, text).select(key, "start", "end", "kind")


register_detector("rules", _rules)


def ensemble(df: DataFrame, key: str, names: list[str], text: str = "text", skipped: list[str] | None = None, reasons: dict[str, str] | None = None) -> DataFrame:
    """Union of the named detectors; overlapping hits become one span, the earliest names the kind.

    A detector that is unknown or cannot build its plan is left out, so the others always run. Its name
    goes to ``skipped`` and what went wrong to ``reasons``, by name, and to the log, so that a fault is told from a missing one.
    """
    parts, left_out = [], {}
    for listed, name in enumerate(names):
        detector, reason = _REGISTRY.get(name), "unknown"
        if detector is not None:
            try:
                parts.append(detector(df, key, text).select(key, "start", "end", F.lit(listed).alias("listed"), "kind"))
                continue
            except Exception as e:
                reason = f"{type(e).__name__}: {e}"
        _LOG.warning("detector %s is left out: %s", name, reason)
        left_out[name] = reason
        if skipped is not None:
            skipped.append(name)
    if reasons is not None:
        reasons.update(left_out)
    if not parts:
        raise ValueError(f"no detector could run: {left_out}")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    merged = hits.groupBy(key).agg(
        merge_overlapping(F.collect_set(F.struct("start", "end", "listed", "kind"))).alias("spans")
    )
    return unnest(merged, "spans", "s", key).select(key, "s.*")
