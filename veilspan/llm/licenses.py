"""Operator 11, license scans: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

A text is brought to the form ``~word ~word ``: A-Z lower-cased, words as in ``GAP``. A rule is a row of tokens, each a regular expression
over one word ("a|b" for alternatives, "x?" for a word that may be missing), and so a regular expression over that form. Rules are
ordered by priority (1 identifiers, addresses and license texts; 2 notices; 3 names with version; 4 names; 5 mentions), then place in the list.

Three gates come before a rule runs: the text has a word that starts with one of ``ANCHORS``; it has the rule's keyword, the rarest
word among the rules that the rule cannot do without; and it matches. Only then are places counted. A detection goes if another one
contains it whose priority is as high or higher; of equal stretches the earlier rule's stays. Detections are sorted by
start and falling end, so that a containing one stands before, and running maxima of the ends for each priority decide in n log n steps.

All of it is expressions on the row that holds the text: nothing is shuffled, there is no Python worker, and a lost executor costs its tasks.

Edge cases: null, empty and wordless texts have no words, no places, empty labels and score 0; a null doc_id is kept; repeated rows are
scanned one by one; an empty table gives an empty table; columns of other names are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.spans import bind, computed, running
from veilspan.llm.common import query, read

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212a"  # the one other letter whose lower case is in a-z

# Public names, identifiers, addresses and sentences of licenses.
#: Phrases whose places the contract counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, name, abbreviation, versions.
FAMILIES = (
    ("gpl", "gnu? general public licen[cs]e", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "gnu? lesser|library general public licen[cs]e", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "gnu? affero general public licen[cs]e", "agpl", ("1.0", "3.0")),
    ("gfdl", "gnu? free documentation licen[cs]e", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache software? licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla public licen[cs]e", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public licen[cs]e", "epl", ("1.0", "2.0")),
    ("cddl", "common development and distribution licen[cs]e", "cddl", ("1.0", "1.1")),
    ("cpl", "common public licen[cs]e", "cpl", ("1.0",)),
    ("eupl", "european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2")),
    ("afl", "academic free licen[cs]e", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open software licen[cs]e", "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("artistic", "perl? artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    ("bsl", "boost software licen[cs]e", "bsl", ("1.0",)),
    ("ofl", "sil? open font licen[cs]e", "ofl", ("1.0", "1.1")),
    ("odbl", "open data commons? open? database licen[cs]e", "odbl", ("1.0",)),
    ("odc-by", "open data commons attribution licen[cs]e", "odc by", ("1.0",)),
    ("psf", "python software foundation licen[cs]e", "psf", ("2.0",)),
    ("php", "php licen[cs]e", "php", ("3.0", "3.01")),
    ("zpl", "zope public licen[cs]e", "zpl", ("1.1", "2.0", "2.1")),
    ("lppl", "latex project public licen[cs]e", "lppl", ("1.0", "1.2", "1.3")),
    ("ecl", "educational community licen[cs]e", "ecl", ("1.0", "2.0")),
    ("rpl", "reciprocal public licen[cs]e", "rpl", ("1.1", "1.5")),
    ("cecill", "cecill free? software? licen[cs]e", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("upl", "universal permissive licen[cs]e", "upl", ("1.0",)),
    ("sspl", "server side public licen[cs]e", "sspl", ("1.0",)),
    ("busl", "business source licen[cs]e", "busl", ("1.1",)),
    ("elastic", "elastic licen[cs]e", "elastic", ("1.0", "2.0")),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", ()),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", ()),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa", ()),
    ("mit", "mit|expat licen[cs]e", "mit", ()),
    ("mit-0", "mit no attribution licen[cs]e", "mit 0", ()),
    ("x11", "x11 licen[cs]e", "x11", ()),
    ("isc", "isc licen[cs]e", "isc", ()),
    ("zlib", "zlib libpng? licen[cs]e", "zlib", ()),
    ("unlicense", "the? unlicen[cs]e", "unlicense", ()),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl", ()),
    ("beerware", "beerware|beer ware? licen[cs]e", "beerware", ()),
    ("postgresql", "postgresql licen[cs]e", "postgresql", ()),
    ("openssl", "openssl licen[cs]e", "openssl", ()),
    ("vim", "vim licen[cs]e", "vim", ()),
    ("ruby", "ruby licen[cs]e", "ruby", ()),
    ("json", "json licen[cs]e", "json", ()),
    ("curl", "curl licen[cs]e", "curl", ()),
    ("w3c", "w3c software notice? and? licen[cs]e", "w3c", ()),
    ("sleepycat", "sleepycat licen[cs]e", "sleepycat", ()),
    ("qpl", "q public licen[cs]e", "qpl", ("1.0",)),
    ("bsd", "bsd style? licen[cs]e", "bsd", ()),
    ("0bsd", "zero|0 clause bsd licen[cs]e", "0bsd", ()),
    ("bsd-2-clause", "simplified|freebsd|2|two clause? bsd licen[cs]e", "bsd 2 clause", ()),
    ("bsd-3-clause", "modified|revised|new|3|three clause? bsd licen[cs]e", "bsd 3 clause", ()),
    ("bsd-4-clause", "original|4|four clause? bsd licen[cs]e", "bsd 4 clause", ()),
)
#: Kinds of Creative Commons licenses: identifier, name.
COMMONS = (
    ("by", "attribution"), ("by-sa", "attribution sharealike|share alike?"), ("by-nc", "attribution noncommercial|non commercial?"),
    ("by-nd", "attribution noderivatives|noderivs|no derivatives|derivs?"), ("by-nc-sa", "attribution noncommercial|non commercial? sharealike|share alike?"),
    ("by-nc-nd", "attribution noncommercial|non commercial? noderivatives|noderivs|no derivatives|derivs?"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Addresses and sentences that stand for one license by themselves.
SIGNATURES = (
    ("mit", "opensource org licen[cs]es mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "www? apache org licen[cs]es licen[cs]e 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of .+ nor the names of its contributors may be used to endorse or promote products .* redistribut.*"),
    ("gpl", "www? gnu org licen[cs]es gpl"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "www? gnu org licen[cs]es lgpl"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "www? gnu org licen[cs]es agpl"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl 2 0 licen[cs]e?"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "cc0 1 0 universal?"),
    ("cc0", "cc0"),
    ("cc0", "creative commons zero"),
    ("public-domain", "released|placed|dedicated to|in|into the public domain"),
    ("public-domain", "public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "unauthorized copying of this file .* copyright.*"),
    ("copyleft", "copyleft"),
    ("warranty-disclaimer", "without warranty of any kind"),
    ("warranty-disclaimer", "without warranties or conditions of any kind"),
    ("commons-clause", "commons clause licen[cs]e condition"),
)
#: Word beginnings one of which every rule needs.
ANCHORS = (
    "licen", "unlicen", "spdx", "granted", "redistribut", "warrant", "reserved", "domain", "publicdomain", "copyright", "copyleft", "commons", "creativecommons", "cc", "mpl", "misrepresented",
    "gpl", "lgpl", "agpl",
)
TERMS = "under|by the? terms? and? conditions? of? the? a?"
NOTICE, SHORT_NOTICE = f"licen[cs]ed|released|distributed|available|published|provided|covered|offered {TERMS}", f"licen[cs]ed {TERMS}"
LATER = "or at? your? option? any? later versions?"
#: Confidence of a detection by its rule's priority.
WEIGHTS = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.7, 5: 0.4}


def numbers(version: str) -> str:
    """A version as tokens; a last 0 may be missing, and a v may stand before it or be part of it."""
    first, last = version.split(".")
    return f"version|ver|v? v?{first} {last}{'?' if last == '0' else ''}"


def rules() -> list[tuple[int, str, str]]:
    """priority, label and tokens of all rules, in order."""
    found = [(1, label, tokens) for label, tokens in SIGNATURES if len(tokens.split()) > 3]
    found += [(5, label, tokens) for label, tokens in SIGNATURES if len(tokens.split()) <= 3]
    named = []
    for label, name, short, versions in FAMILIES:
        named.append((label, name, short, None))
        named += [(f"{label}-{v}", name, short, v) for v in versions]
    for kind, words in COMMONS:
        parts = kind.replace("-", " ")
        named.append((f"cc-{kind}", f"creative commons {words}", f"cc {parts}", None))
        for v in COMMONS_VERSIONS:
            named.append((f"cc-{kind}-{v}", f"creative commons {words} international|unported|generic? licen[cs]e?", f"cc {parts}", v))
            found.append((1, f"cc-{kind}-{v}", f"creativecommons org licen[cs]es {parts} {v.replace('.', ' ')}"))
    for label, name, short, version in named:
        one = short.split()[0] if len(short.split()) == 1 else None
        if version is None:
            found += [(2, label, f"{NOTICE} {name}"), (4, label, name), (1, label, f"spdx licen[cs]e identifier {short}"), (4, label, f"{short} licen[cs]e|licen[cs]ed")]
            if label.startswith("cc-"):
                found += [(2, label, f"{NOTICE} {short}"), (4, label, short)]
            continue
        v = numbers(version)
        full = f"{name} {v}"
        found += [(1, label, f"spdx licen[cs]e identifier {short} {v}"), (2, label, f"{NOTICE} {full}"), (2, label, f"{SHORT_NOTICE} {short} {v}"), (3, label, full), (3, label, f"{short} {v} licen[cs]e")]
        if label.startswith("cc-"):
            found.append((3, label, f"{short} {v}"))
        if short.endswith("gpl"):
            major = version.split(".")[0]
            found += [(3, label, f"{short} {v}"), (2, f"{label}-or-later", f"{NOTICE} {full} {LATER}"), (2, f"{label}-or-later", f"{full} {LATER}"), (1, f"{label}-or-later", f"spdx licen[cs]e identifier {short} {v} or later")]
            if version.endswith(".0"):
                found.append((3, label, f"{one}v{major}"))
    found += [(5, label, phrase) for phrase, label in BASE]
    return sorted(dict.fromkeys(found), key=lambda r: r[0])


def pattern(tokens: str) -> str:
    """Tokens as a regular expression over the ``~word `` form."""
    parts = []
    for token in tokens.split():
        body = token.removesuffix("?")
        body = f"~(?:{body}) " if "|" in body else f"~{body} "
        parts.append(f"(?:{body})?" if token.endswith("?") else body)
    return "".join(parts).replace("~.+ ", "(?:~[^~ ]+ ){1,12}").replace("~.* ", "(?:~[^~ ]+ ){0,12}").replace(".*", "[^~ ]*")


def needed(tokens: str) -> list[str]:
    """The plain words a text must have to match."""
    return [t for t in tokens.split() if re.fullmatch("[a-z0-9]+", t)]


def anchored(tokens: str) -> bool:
    return any(not t.endswith("?") and all(x.startswith(ANCHORS) for x in t.split("|")) for t in tokens.split())


def gates(listed: list[tuple[int, str, str]]) -> list[dict]:
    """Rules under their keywords: of the words a rule needs, the one that the fewest rules need."""
    if loose := [tokens for _, _, tokens in listed if not anchored(tokens)]:
        raise ValueError(f"rules without an anchor: {loose}")
    uses = Counter(w for _, _, tokens in listed for w in set(needed(tokens)))
    found: dict[str, list[dict]] = {}
    for place, (priority, label, tokens) in enumerate(listed):
        keyword = min(needed(tokens), key=lambda w: (uses[w], -len(w), w), default="")
        found.setdefault(f"~{keyword} " if keyword else "~", []).append({"place": place, "priority": priority, "label": label, "pattern": pattern(tokens)})
    return [{"keyword": k, "rules": v} for k, v in found.items()]


RULES = rules()
RULE_DDL = "struct<place:int,priority:int,label:string,pattern:string>"
FOUND_DDL = "struct<start:int,shorter:int,place:int,priority:int,label:string>"


def normal(text: Column) -> Column:
    """The text's words, each as ``~word ``."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("ĸ")))
    spaced = F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), GAP, " ~")
    return F.substring(spaced, F.lit(2), F.length(spaced) - 2)


def word_count(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit("~"), F.lit("")))


def places(form: Column, regex: Column) -> Column:
    """start and n, in words, of every match from left to right."""
    pairs = F.zip_with(F.split(form, regex, -1), F.regexp_extract_all(form, regex, F.lit(0)), lambda gap, hit: F.struct(word_count(gap).alias("gap"), word_count(hit).alias("n")))
    return bind(F.filter(pairs, lambda p: p["n"].isNotNull()), lambda held: F.zip_with(
        held, running(F.transform(held, lambda p: p["gap"] + p["n"])), lambda p, end: F.struct((end - p["n"]).alias("start"), p["n"].alias("n"))
    ))


def labelled_places(form: Column, regex: str, label: str) -> Column:
    """start and label of every place of one fixed phrase."""
    none = F.from_json(F.lit("[]"), "array<struct<start:int,label:string>>")
    return F.when(form.contains(regex), F.transform(places(form, F.lit(regex)), lambda p: F.struct(p["start"].alias("start"), F.lit(label).alias("label")))).otherwise(none)


def candidates(form: Column, listed: list[tuple[int, str, str]] | None = None) -> Column:
    """All matches of all rules, sorted by start, falling end and place."""
    fixed = F.from_json(F.lit(json.dumps(gates(RULES if listed is None else listed))), f"array<struct<keyword:string,rules:array<{RULE_DDL}>>>")
    open_gates = F.flatten(F.transform(F.filter(fixed, lambda g: form.contains(g["keyword"])), lambda g: g["rules"]))
    fired = F.filter(open_gates, lambda r: F.rlike(form, r["pattern"]))
    hits = F.flatten(F.transform(fired, lambda r: F.transform(places(form, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["n"]).alias("shorter"), r["place"].alias("place"), r["priority"].alias("priority"), r["label"].alias("label")
    ))))
    none = F.from_json(F.lit("[]"), f"array<{FOUND_DDL}>")
    return F.when(form.rlike("~(?:" + "|".join(ANCHORS) + ")"), F.array_sort(hits)).otherwise(none)


def running_max(values: Column) -> Column:
    """The greatest of each element and all before it, by doubling."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(30)), values,
        lambda acc, k: F.when(
            F.size(acc) > F.call_function("shiftleft", F.lit(1), k),
            F.transform(acc, lambda v, i: F.greatest(v, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))),
        ).otherwise(acc),
    )


def settled(found: Column) -> Column:
    """The detections that no other one contains whose priority is as high or higher; ``found`` is sorted by start and falling end."""

    def judged(held: Column) -> Column:
        def ends_of(priority: int) -> Column:
            return running_max(F.transform(held, lambda c: F.when(c["priority"] <= priority, c["start"] - c["shorter"]).otherwise(F.lit(0))))

        ends = F.array(*[ends_of(p) for p in sorted(WEIGHTS)])
        return bind(ends, lambda e: F.filter(held, lambda c, i: (i == 0) | (F.get(F.get(e, c["priority"] - 1), i - 1) < c["start"] - c["shorter"])))

    return F.when(F.size(found) > 1, bind(found, judged)).otherwise(found)


def scan(docs: DataFrame, listed: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, base (places of the base phrases with label) and detections (start, end, label, priority, weight) of each row."""
    formed = computed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("form")), F.col("form"), "words").drop("form")
    form = F.col("words")
    base = F.flatten(F.array(*[labelled_places(form, pattern(phrase), label) for phrase, label in BASE]))
    weights = F.create_map(*[F.lit(x) for pair in sorted(WEIGHTS.items()) for x in pair])
    kept = F.transform(settled(candidates(form, listed)), lambda c: F.struct(
        c["start"].cast("long").alias("start"), (c["start"] - c["shorter"]).cast("long").alias("end"), c["label"].alias("label"), c["priority"].alias("priority"), weights[c["priority"]].alias("weight")
    ))
    return formed.select("doc_id", word_count(form).cast("long").alias("n_words"), base.alias("base"), kept.alias("detections"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and places of the base phrases, the labels, and the weight of the surest detection as score."""
    starts, own = F.transform("base", lambda b: b["start"]), F.transform("base", lambda b: b["label"])
    labels = F.concat(own, F.transform("detections", lambda d: d["label"]))

    def joined(values: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(values)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"), joined(labels).alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    listed = ",\n".join(f"({place}, {priority}, '{label}', '{pattern(tokens)}', {WEIGHTS[priority]}::double)" for place, (priority, label, tokens) in enumerate(RULES))
    base = ", ".join(f"('{pattern(phrase)}', '{label}')" for phrase, label in BASE)
    anchors = "~(?:" + "|".join(ANCHORS) + ")"
    return f"""
WITH formed AS (
  SELECT row_number() OVER () AS row, doc_id, '~' || array_to_string(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> ''), ' ~') || ' ' AS form FROM documents),
texts AS MATERIALIZED (SELECT row, doc_id, CASE WHEN form = '~ ' THEN '' ELSE form END AS form FROM formed),
counted AS (SELECT row, doc_id, length(form) - length(replace(form, '~', '')) AS n_words FROM texts),
rules(place, priority, label, pattern, weight) AS (VALUES {listed}),
base_rules(pattern, label) AS (VALUES {base}),
base_cut AS (SELECT row, label, form, pattern, string_split(form, pattern) AS gaps FROM texts JOIN base_rules ON contains(form, pattern)),
base_at AS (
  SELECT row, label, list_sum(list_transform(gaps[:k], lambda g: length(g) - length(replace(g, '~', ''))))::bigint + (k - 1) * (length(pattern) - length(replace(pattern, '~', ''))) AS start
  FROM base_cut, unnest(range(1, len(gaps))) AS t(k)),
base AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base_at GROUP BY row),
cut AS (
  SELECT row, place, priority, label, weight, string_split_regex(form, pattern) AS gaps, regexp_extract_all(form, pattern) AS hits
  FROM (SELECT * FROM texts WHERE regexp_matches(form, '{anchors}')) JOIN rules ON regexp_matches(form, pattern)),
hits AS (
  SELECT row, place, priority, label, weight, list_sum(list_transform(gaps[:k], lambda g: length(g) - length(replace(g, '~', ''))))::bigint
      + coalesce(list_sum(list_transform(hits[:k - 1], lambda g: length(g) - length(replace(g, '~', ''))))::bigint, 0) AS start, length(hits[k]) - length(replace(hits[k], '~', '')) AS n
  FROM cut, unnest(range(1, len(hits) + 1)) AS t(k)),
kept AS (
  SELECT * FROM hits AS a WHERE NOT EXISTS (
    SELECT 1 FROM hits AS b WHERE b.row = a.row AND b.start <= a.start AND b.start + b.n >= a.start + a.n AND b.priority <= a.priority AND (b.n > a.n OR b.place < a.place))),
labelled AS (SELECT row, label FROM base_at UNION SELECT row, label FROM kept),
named AS (SELECT row, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY row),
scored AS (SELECT row, max(weight) AS score FROM kept GROUP BY row)
SELECT doc_id, n_words::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM counted LEFT JOIN base USING (row) LEFT JOIN named USING (row) LEFT JOIN scored USING (row)"""


@query("op11_license_rules", _sql())
def op11_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return digest(scan(read(spark, folder, "documents")))
