"""Training rows from reviewer corrections and stored completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import unnest
from veilspan.functions.text import blank_words, paragraphs, strip
from veilspan.operators.containment import contaminated
from veilspan.operators.evalrows import dash_list

SPAN_DDL = "struct<text:string,kind:string,replacement:string>"
COMPLETION_DDL = "struct<spans:array<struct<text:string,kind:string>>>"


def _placeholder_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in P.SPAN_KINDS.items() for x in kv]), kind)


def _kind_of(placeholder: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in P.SPAN_KINDS.items() for x in (v, k)]), placeholder)


def system_prompt(practice: Column, may: Column, never: Column) -> Column:
    """Policy prompt of a practice: what never leaves, what may be reused, the span kinds, the reply form."""
    kinds = "\n".join(f"- {k} -> {v}" for k, v in P.SPAN_KINDS.items())
    head, policy, reuse, task, reply = P.DEID_PROMPT
    return F.concat(
        F.lit(head), practice, F.lit(policy), dash_list(never), F.lit(reuse), F.array_join(may, ", "), F.lit(task + kinds + reply)
    )


def valid_spans(passage: Column, raw: Column) -> Column:
    """Exact, non-blank substrings of the passage, each text once (the first), kinds from the closed list."""
    usable = F.filter(raw, lambda s: s["text"].isNotNull() & (strip(s["text"]) != "") & passage.contains(s["text"]))
    texts = F.transform(usable, lambda s: s["text"])
    frame = F.array(F.struct(usable.alias("spans"), texts.alias("texts")))

    def typed(s: Column) -> Column:
        kind = F.when(s["kind"].isin(*P.SPAN_KINDS), s["kind"]).otherwise("quasi_identifier")
        return F.struct(s["text"].alias("text"), kind.alias("kind"), _placeholder_of(kind).alias("replacement"))

    kept = F.transform(frame, lambda f: F.transform(
        F.filter(f["spans"], lambda s, i: F.array_position(f["texts"], s["text"]) == i + 1), typed
    ))
    return F.coalesce(F.flatten(kept), F.from_json(F.lit("[]"), f"array<{SPAN_DDL}>"))


def parse_completion(passage: Column, completion: Column) -> Column:
    """Spans of a stored completion; none when it holds no JSON object."""
    body = F.regexp_extract(F.regexp_replace(completion, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)
    return valid_spans(passage, F.from_json(body, COMPLETION_DDL)["spans"])


def corrected_span(text: Column, kind: Column, replacement: Column) -> Column:
    """A span with a known kind: its own, else that of its placeholder (numbering dropped), else quasi."""
    plain = F.coalesce(replacement, F.lit(""))
    base = F.regexp_replace(plain, r"_[0-9]+\]$", "]")
    known = F.when(kind.isin(*P.SPAN_KINDS), kind)
    final = F.coalesce(known, _kind_of(plain), _kind_of(base), F.lit("quasi_identifier"))
    return F.struct(text.alias("text"), final.alias("kind"), _placeholder_of(final).alias("replacement"))


def target_spans(spans: Column, kind: Column, span_text: Column, span_kind: Column, replacement: Column) -> Column:
    """The model's spans without the corrected text, plus the corrected one when it was missed."""
    none = F.from_json(F.lit("[]"), f"array<{SPAN_DDL}>")
    rest = F.filter(F.coalesce(spans, none), lambda s: s["text"].isNotNull() & (s["text"] != "") & (s["text"] != span_text))
    fixed = F.transform(rest, lambda s: corrected_span(s["text"], s["kind"], s["replacement"]))
    return F.when(kind == "missed", F.concat(fixed, F.array(corrected_span(span_text, span_kind, replacement)))).otherwise(fixed)


def valid_corrections(corrections: DataFrame) -> DataFrame:
    """Split by ``reason``: null when the correction can be recorded."""
    reason = F.when(~F.coalesce(F.col("kind").isin("missed", "wrong"), F.lit(False)), "kind must be missed or wrong").when(
        ~F.coalesce(F.col("passage").contains(F.col("span_text")), F.lit(False)), "span_text must appear in passage"
    )
    return corrections.withColumn("reason", reason)


def training_rows(corrections: DataFrame, policy: DataFrame) -> DataFrame:
    """Corrections to chat rows: system prompt of the practice, the passage, the corrected spans as JSON."""
    rules = policy.select("practice", "may_compound", "never_compounds")
    joined = corrections.join(rules, "practice")
    spans = target_spans(F.col("spans"), F.col("kind"), F.col("span_text"), F.col("span_kind"), F.col("replacement"))
    return joined.select(
        F.array(
            F.struct(F.lit("system").alias("role"), system_prompt(F.col("practice"), F.col("may_compound"), F.col("never_compounds")).alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("passage").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.to_json(F.struct(spans.alias("spans"))).alias("content")),
        ).alias("messages"),
        F.lit("attorney_feedback").alias("source"), "kind", "matter_id",
    )


def user_text(messages: Column) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), " ")


def correction_summary(corrections: DataFrame) -> DataFrame:
    return corrections.agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "missed").alias("missed"), F.count_if(F.col("kind") == "wrong").alias("wrong")
    )


def base_sample(rows: DataFrame, key: str, seed: int = 0, cap: int = P.BASE_ROW_CAP) -> DataFrame:
    """At most ``cap`` labelled base rows for fitting, drawn by a digest of seed and key: a top-k, so no full sort.

    ``cap`` bounds what the tuned model is fitted on beside the feedback rows; it is the caller's choice and drops nothing else.
    """
    draw = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_draw", draw).orderBy("_draw", key).limit(cap).drop("_draw")


def upsample(feedback: DataFrame, base: DataFrame, copies: int = P.FEEDBACK_COPIES) -> DataFrame:
    """Base rows once and feedback rows ``copies`` times."""
    repeated = feedback.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return base.withColumn("copy", F.lit(1)).unionByName(repeated)


def retrain_plan(n_feedback: DataFrame, n_base: DataFrame) -> DataFrame:
    """``n_feedback, n_base, n_examples`` from two one-row counts."""
    stacked = n_feedback.select(F.col("n").alias("f"), F.lit(0).cast("bigint").alias("b")).unionByName(
        n_base.select(F.lit(0).cast("bigint").alias("f"), F.col("n").alias("b"))
    )
    return stacked.agg(F.sum("f").alias("n_feedback"), F.sum("b").alias("n_base")).withColumn(
        "n_examples", F.col("n_base") + F.col("n_feedback") * P.FEEDBACK_COPIES
    )


def holdout_texts(rows: DataFrame, key: str) -> DataFrame:
    """Drafts, current blocks and user messages of held-out rows, one row per text."""
    texts = F.concat(
        F.array(F.col("draft"), F.col("current")),
        F.coalesce(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), F.from_json(F.lit("[]"), "array<string>")),
    )
    return unnest(rows, texts, "text", key, at="i").select(
        F.concat_ws("/", F.col(key).cast("string"), F.col("i").cast("string")).alias("holdout_id"), "text"
    )


def refuse_overlap(rows: DataFrame, row_key: str, holdout: DataFrame, holdout_key: str = "holdout_id") -> DataFrame:
    """The rows unchanged; raises when any of them overlaps a held-out text."""
    hits = contaminated(rows, row_key, holdout, holdout_key, P.HOLDOUT_MIN_CHARS)
    if hits.limit(1).count():
        raise ValueError("training rows overlap the held-out set; refusing to build")
    return rows


def build_training_set(base: DataFrame, key: str, feedback: DataFrame, holdout: DataFrame, holdout_key: str, seed: int = 0, cap: int = P.BASE_ROW_CAP) -> DataFrame:
    """``messages, copy``: a bounded sample of base rows once, feedback rows several times; refused if any overlaps a held-out text.

    ``base`` and ``feedback`` have ``messages``. Rows are checked once each, before they are copied.
    """
    sample = base_sample(base, key, seed, cap).select("messages")
    once = sample.unionByName(feedback.select("messages"))
    refuse_overlap(once.select(F.xxhash64(F.to_json("messages")).alias("row"), user_text(F.col("messages")).alias("text")), "row", holdout, holdout_key)
    return upsample(feedback.select("messages"), sample)


def split_by_matter(rows: DataFrame, held_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, held out) by matter list."""
    listed = held_out.select("matter_id").distinct()
    return rows.join(listed, "matter_id", "left_anti"), rows.join(listed, "matter_id", "left_semi")


def training_paragraphs(docs: DataFrame, keys: list[str], separator: str = "\n\n", min_words: int = 12) -> DataFrame:
    """Trimmed paragraphs of at least ``min_words`` words."""
    pieces = unnest(docs, paragraphs(F.col("text"), separator), "paragraph", *keys, at="i")
    return pieces.where(F.size(blank_words(F.col("paragraph"))) >= min_words)


def label_stats(labelled: DataFrame) -> DataFrame:
    """``metric, kind, n`` over ``spans`` (null when labelling failed): rows, dropped, spans, empty rows, spans by kind."""
    totals = labelled.agg(
        F.count("spans").alias("rows"), F.count_if(F.col("spans").isNull()).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("spans").isNotNull(), F.size("spans"))), F.lit(0)).alias("spans"), F.count_if(F.size("spans") == 0).alias("empty_rows"),
    )
    stacked = totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("kind"), F.col(c).cast("bigint").alias("n")) for c in ("rows", "dropped", "spans", "empty_rows")
    ])))
    kinds = unnest(labelled, "spans.kind", "kind").groupBy("kind").agg(F.count("*").alias("n"))
    listed = labelled.sparkSession.createDataFrame([(k,) for k in P.SPAN_KINDS], "kind string")
    by_kind = listed.join(kinds, "kind", "left").select(F.lit("kind").alias("metric"), "kind", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    return stacked.unionByName(by_kind)


def pending(cases: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Cases without a usable stored verdict; failed ones are tried again."""
    return cases.join(verdicts.where(F.col("verdict").isNotNull()).select(key).distinct(), key, "left_anti")


def attach_verdicts(cases: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    return cases.join(verdicts.select(key, "verdict"), key, "left")
