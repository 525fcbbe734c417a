"""Amounts: digits-only value, written variants, and the mentions a text can offer them.

A variant and a mention meet on ``(form, key)``, so looking for many amounts in
many texts is an equi-join instead of one regex per amount.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import patterns as P
from veilspan.functions.spans import scan

MENTION_DDL = "struct<form:string,key:string,start:int,end:int>"
# order in which the forms of one amount are tried
FORMS = ("grouped", "digits", "kilo", "thousand", "million")


def amount_value(raw: Column) -> Column:
    """Digits only: ``$418,250`` is 418250 and ``$418,250.00`` is 41825000. Null without digits."""
    return F.nullif(F.regexp_replace(raw, "[^0-9]", ""), F.lit("")).try_cast("decimal(38,0)")


def _plain(value: Column) -> Column:
    return value.cast("decimal(38,0)").cast("string")


def _grouped(value: Column) -> Column:
    return F.regexp_replace(_plain(value), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def _millions(value: Column) -> Column:
    """Millions with up to six significant digits and no trailing zeros."""
    whole = F.floor(value / F.lit(1000000))
    tenth = F.floor((value % F.lit(1000000)) / F.lit(100000))
    short = F.concat(_plain(whole), F.when(tenth == 0, F.lit("")).otherwise(F.concat(F.lit("."), _plain(tenth))))
    sixth = F.bround(value.cast("double") / F.lit(1e6), 0).cast("decimal(38,0)")
    science = F.regexp_replace(
        F.format_string("%.5e", value.cast("double") / F.lit(1e6)), r"\.?0+e", "e"
    )
    return F.when(whole < 100000, short).when((whole < 1000000) & (sixth < 1000000), _plain(sixth)).otherwise(science)


def variants(raw: Column) -> Column:
    """``array<struct<form, key, value>>`` of the ways an amount is written in prose."""
    value = amount_value(raw)
    kilo = F.when((value % F.lit(1000)) == 0, _plain(F.floor(value / F.lit(1000))))
    million = F.when((value >= 1000000) & ((value % F.lit(100000)) == 0), _millions(value))
    keys = dict(zip(FORMS, (_grouped(value), _plain(value), kilo, kilo, million)))
    every = F.array(*[F.struct(F.lit(f).alias("form"), k.alias("key"), value.alias("value")) for f, k in keys.items()])
    return F.filter(every, lambda v: v["key"].isNotNull())


def _mention(form: str, key: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(form).alias("form"), key.alias("key"), start.alias("start"), end.alias("end"))


def mentions(text: Column) -> Column:
    """Everything in a text that some variant would match, with its offsets."""
    # "$418,250.75" offers the grouped keys 4, 41, 418 and 418,250; only the last carries the cents
    heads = scan(
        text,
        r"\$[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?",
        lambda at, m, gap: F.struct(at.alias("start"), m.alias("match")),
        "struct<start:int,match:string>",
        ("$",),
    )
    grouped = F.flatten(
        F.transform(
            heads,
            lambda h: F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.length(F.regexp_extract(h["match"], r"^\$([0-9,]+)", 1))),
                    lambda i: _mention(
                        "grouped",
                        h["match"].substr(F.lit(2), i),
                        h["start"],
                        h["start"] + 1 + i + F.length(F.regexp_extract(h["match"].substr(i + 2, F.length(h["match"])), r"^\.[0-9]+", 0)),
                    ),
                ),
                lambda v: v["key"].rlike(r"^[0-9]{1,3}(?:,[0-9]{3})*$"),
            ),
        )
    )

    def simple(form: str, pattern: str, group: str, *hints: str) -> Column:
        return scan(
            text,
            pattern,
            lambda at, m, gap: _mention(form, F.regexp_extract(m, group, 1), at, at + F.length(m)),
            MENTION_DDL,
            hints,
        )

    found = F.concat(
        grouped,
        simple("digits", r"[0-9]+", r"([0-9]+)"),
        simple("kilo", rf"(?i)\$[0-9]+{P.SPACE}*K{P.CLOSE}", r"([0-9]+)", "$"),
        simple("thousand", rf"(?i)(?=[0-9]){P.OPEN}[0-9]+{P.SPACE}+thousand{P.SPACE}+dollars{P.CLOSE}", r"([0-9]+)", "thousand"),
        simple("million", rf"(?i)\$[0-9][0-9.e+]*{P.SPACE}*million{P.CLOSE}", r"^\$([0-9.eE+]+)", "million"),
    )
    return F.filter(found, lambda m: (m["form"] == "grouped") | ~m["key"].rlike("^0[0-9]"))
