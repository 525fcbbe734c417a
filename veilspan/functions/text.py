"""Tokens, word n-grams and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions import patterns as P

UNICODE_TOKEN = r"[\p{L}\p{N}']+"


def words(text: Column, pattern: str = P.CARRY_TOKEN) -> Column:
    """Lower-cased word tokens; pass ``UNICODE_TOKEN`` to keep accented letters inside words."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def word_ngrams(tokens: Column, n: int = P.CARRY_N) -> Column:
    """Sliding n-grams in reading order; fewer than ``n`` tokens give none."""
    none = F.from_json(F.lit("[]"), "array<string>")

    def windows(held: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(held) - (n - 1))
        return F.when(F.size(held) >= n, F.transform(starts, lambda i: F.array_join(F.slice(held, i, F.lit(n)), " "))).otherwise(none)

    # the tokens are bound once as a lambda variable, not computed again for every window
    return F.flatten(F.transform(F.array(tokens), windows))


def gram_key(gram: Column) -> Column:
    """128-bit key of a gram: two 64-bit hashes with different seeds, 16 bytes through the shuffle."""
    return F.struct(F.xxhash64(gram).alias("h1"), F.xxhash64(F.lit("veil"), gram).alias("h2"))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Trimmed, non-empty pieces between separators."""
    return F.filter(F.transform(F.split(text, separator, -1), strip), lambda p: p != "")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{P.SPACE}+|{P.SPACE}+$", "")


def blank_words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, rf"{P.SPACE}+", -1), lambda w: w != "")
