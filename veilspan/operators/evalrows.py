"""Labelled rows: parsers for both shapes, and the two detectors on a row's own matter blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.amounts import amount_value, mentions, variants
from veilspan.functions.spans import bind, computed
from veilspan.functions.text import strip, word_ngrams, words

BLOCK_DDL = "struct<matter_id:string,names:array<string>,orgs:array<string>,amounts:array<string>,text:string>"
FLAT_DDL = "id string, trick string, category string, current string, protected array<string>, draft string, label string"
CHAT_DDL = "messages array<struct<role:string,content:string>>, meta struct<label:string>"


_CUT = "\x01"


def parse_block(text: Column, fallback_id: Column) -> Column:
    """Matter prose as a struct; null when it does not follow the block form.

    One regex pass: the groups are written out with a control character between
    them and split again (that character counts as a blank in the prose).
    """
    body = strip(F.translate(text, _CUT, " "))
    head, pattern = "(?s)", P.MATTER_BLOCK.removeprefix("(?s)")
    groups = _CUT.join(f"${i}" for i in range(1, 8))

    def built(prose: Column) -> Column:
        return bind(F.split(F.regexp_replace(prose, f"{head}^.*?{pattern}.*$", groups), _CUT, -1), lambda g: _block(prose, g, fallback_id))

    return bind(body, built)


def _block(body: Column, g: Column, fallback_id: Column) -> Column:
    names = F.filter(F.array_distinct(F.array(strip(g[1]), strip(g[3]))), lambda n: n != "")
    return F.when(
        F.size(g) == 7,
        F.struct(
            F.coalesce(F.nullif(strip(g[0]), F.lit("")), fallback_id).alias("matter_id"),
            names.alias("names"),
            F.array(strip(g[2])).alias("orgs"),
            F.filter(F.array(F.regexp_extract(g[6], P.BLOCK_AMOUNT, 0)), lambda a: a != "").alias("amounts"),
            body.alias("text"),
        ),
    )


def protected_blocks(lines: Column) -> Column:
    """Parsed blocks of the protected lines; for a repeated id the last one counts, at its first place."""
    cleaned = F.transform(lines, lambda l: strip(F.regexp_replace(strip(l), "^-+", "")))
    parsed = F.filter(
        F.transform(cleaned, lambda l, i: F.when(l != "", parse_block(l, F.concat(F.lit("protected_"), i.cast("string"))))),
        lambda b: b.isNotNull(),
    )
    return bind(parsed, lambda blocks: F.transform(
        F.array_distinct(F.transform(blocks, lambda b: b["matter_id"])),
        lambda wanted: F.element_at(F.filter(blocks, lambda b: b["matter_id"] == wanted), -1),
    ))


def _label(raw: Column) -> Column:
    label = F.upper(raw)
    return F.when(label.isin("LEAK", "CLEAN"), label)


def _row(current: Column, fits: Column, protected: Column, draft: Column, label: Column) -> Column:
    def built(block: Column) -> Column:
        return F.when(
            block.isNotNull() & fits & _label(label).isNotNull(),
            F.struct(block.alias("current"), protected_blocks(protected).alias("protected"), strip(draft).alias("draft"), _label(label).alias("label")),
        )

    return bind(parse_block(current, F.lit("current")), built)


def parse_flat(current: Column, protected: Column, draft: Column, label: Column) -> Column:
    """``struct<current, protected, draft, label>`` of a flat row, null when a part is missing."""
    return _row(current, protected.isNotNull() & draft.isNotNull(), protected, draft, label)


def parse_chat(messages: Column, label: Column) -> Column:
    """The same struct from the user message of a chat row."""
    def cut(user: Column) -> Column:
        head = F.substring_index(user, "DRAFT:", 1)
        current = F.substring_index(head, "PROTECTED (other matters):", 1)
        rest = head.substr(F.length(current) + 27, F.length(head))
        return _row(
            F.replace(current, F.lit("CURRENT MATTER"), F.lit("")), user.contains("DRAFT:"),
            F.split(strip(rest), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]", -1), user.substr(F.length(head) + 7, F.length(user)), label,
        )

    return bind(F.try_element_at(messages, F.lit(2))["content"], cut)


def parse_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines to ``raw columns..., row``; chat shape first, then flat; ``row`` null when neither fits.

    Blank lines are dropped; malformed JSON fails the job.
    """
    fail = {"mode": "FAILFAST"}
    kept = lines.where(strip(F.col(line)) != "")
    both = computed(computed(kept, F.from_json(line, CHAT_DDL, fail), "chat"), F.from_json(line, FLAT_DDL, fail), "flat")
    row = F.coalesce(
        parse_chat(F.col("chat.messages"), F.col("chat.meta.label")),
        parse_flat(F.col("flat.current"), F.col("flat.protected"), F.col("flat.draft"), F.col("flat.label")),
    )
    return computed(both, row, "row")


def judge_case(lines: DataFrame, system_prompt: str, line: str = "value") -> DataFrame:
    """JSON lines to ``case``: current, protected, draft, label and the messages to send."""
    kept = lines.where(strip(F.col(line)) != "")
    both = computed(computed(kept, F.from_json(line, CHAT_DDL), "chat"), F.from_json(line, FLAT_DDL), "flat")
    user = F.try_element_at(F.col("chat.messages"), F.lit(2))["content"]
    label = F.lower(strip(F.coalesce(F.col("chat.meta.label"), F.lit(""))))
    chat = F.when(
        user.rlike(r"CURRENT MATTER (.+)") & user.rlike(r"(?s)DRAFT:\n(.*)") & label.isin("leak", "clean"),
        F.struct(
            strip(F.regexp_extract(user, r"CURRENT MATTER (.+)", 1)).alias("current"),
            F.regexp_extract_all(user, F.lit(r"(?m)^- (.+)$"), F.lit(1)).alias("protected"),
            strip(F.regexp_extract(user, r"(?s)DRAFT:\n(.*)", 1)).alias("draft"),
            label.alias("label"),
            F.slice("chat.messages", F.lit(1), F.size("chat.messages") - 1).alias("messages"),
        ),
    )
    flat_label = F.lower(strip(F.coalesce(F.col("flat.label"), F.lit(""))))
    current, protected, draft = strip(F.col("flat.current")), F.col("flat.protected"), strip(F.col("flat.draft"))
    flat = F.when(
        current.isNotNull() & protected.isNotNull() & draft.isNotNull() & flat_label.isin("leak", "clean"),
        F.struct(
            current.alias("current"), protected.alias("protected"), draft.alias("draft"), flat_label.alias("label"),
            judge_messages(current, protected, draft, system_prompt).alias("messages"),
        ),
    )
    return computed(both, F.coalesce(chat, flat), "case")


def judge_messages(current: Column, protected: Column, draft: Column, system_prompt: str) -> Column:
    """System and user message of one case."""
    user = F.concat(
        F.lit("CURRENT MATTER "), current, F.lit("\n\nPROTECTED (other matters):\n"), dash_list(protected), F.lit("\n\nDRAFT:\n"), draft
    )
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def dash_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda p: F.concat(F.lit("- "), p)), "\n")


def trick_of(*candidates: Column) -> Column:
    """First non-empty of the given columns, else ``?``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit("?"))


def stored_verdict(completion: Column) -> Column:
    """``leak`` / ``clean`` from a stored completion, null when it holds no usable JSON."""
    body = F.when(
        completion.contains("</think>"), completion.substr(F.instr(completion, "</think>") + 8, F.length(completion))
    ).otherwise(completion)
    verdict = F.lower(strip(F.get_json_object(F.regexp_extract(body, r"(?s)\{.*\}", 0), "$.verdict")))
    return F.when(verdict.isin("leak", "clean"), verdict)


# --- detectors on one row's blocks ------------------------------------------


def row_fingerprint_flag(row: Column) -> Column:
    """Does the draft name a fact of a protected block that the current one does not hold itself?"""
    own, draft = row["current"], F.lower(row["draft"])
    own_values = F.transform(own["amounts"], amount_value)
    # the draft's offers are built once and ride along in a one-element array
    offers = F.array(F.transform(mentions(row["draft"]), lambda m: F.concat_ws(" ", m["form"], m["key"])))

    def named(block: Column, field: str) -> Column:
        mine = F.transform(own[field], F.lower)
        return F.exists(block[field], lambda v: draft.contains(F.lower(v)) & ~F.array_contains(mine, F.lower(v)))

    def paid(block: Column, offer: Column) -> Column:
        return F.exists(
            block["amounts"],
            lambda a: ~F.coalesce(F.array_contains(own_values, amount_value(a)), F.lit(True))
            & F.arrays_overlap(F.transform(variants(a), lambda v: F.concat_ws(" ", v["form"], v["key"])), offer),
        )

    return F.exists(row["protected"], lambda b: named(b, "names") | named(b, "orgs")) | F.exists(
        offers, lambda offer: F.exists(row["protected"], lambda b: paid(b, offer))
    )


def row_carryover_flag(row: Column, n: int = P.CARRY_N) -> Column:
    """Does a draft n-gram occur in exactly one protected block and not in the current one?"""
    sides = F.array(
        F.struct(
            F.array_except(word_ngrams(words(row["draft"]), n), word_ngrams(words(row["current"]["text"]), n)).alias("mine"),
            F.transform(row["protected"], lambda b: word_ngrams(words(b["text"]), n)).alias("theirs"),
        )
    )
    return F.exists(
        sides, lambda s: F.exists(s["mine"], lambda g: F.size(F.filter(s["theirs"], lambda t: F.array_contains(t, g))) == 1)
    )
