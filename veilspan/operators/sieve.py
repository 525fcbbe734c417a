"""A Bloom filter of 64-bit keys as a column expression, tested where rows are read and before they meet a table by key.

The filter is counted by Spark: every key sets two bits, bits are combined by word before they shuffle, and the words, at most
``MOST_WORDS``, become a literal of the plan. It keeps every key it was built from; of others it lets about 1 in 70 pass while it has 16
bits a key, more when it is fuller. It only ever saves work: rows that pass are joined by their key afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
#: Words of 64 bits a filter has at least and at most: two kilobytes, half a megabyte.
LEAST_WORDS, MOST_WORDS = 1 << 8, 1 << 16


def words_for(keys: int) -> int:
    """A power of two with room for that many keys."""
    words = LEAST_WORDS
    while words < MOST_WORDS and 64 * words < BITS_A_KEY * keys:
        words *= 2
    return words


def _bits(key: Column, words: int) -> list[Column]:
    last = F.lit(64 * words - 1).cast("long")
    return [key.bitwiseAND(last), F.call_function("shiftrightunsigned", key, F.lit(32)).bitwiseAND(last)]


def _word(bit: Column) -> Column:
    return F.call_function("shiftright", bit, F.lit(6)).cast("int")


def _place(bit: Column) -> Column:
    return bit.bitwiseAND(F.lit(63).cast("long")).cast("int")


def sieve(keys: DataFrame, column: str, count: int) -> Callable[[Column], Column]:
    """``passes(key)`` for a table of ``count`` well-mixed 64-bit keys (as ``xxhash64`` makes them)."""
    words = words_for(count)
    bits = keys.select(F.explode(F.array(*_bits(F.col(column), words))).alias("bit"))
    set_bits = bits.groupBy(_word(F.col("bit")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col("bit")))).alias("held"))
    held = [0] * words
    for r in set_bits.collect():  # at most ``words`` rows
        held[r["word"]] = r["held"]
    fixed = F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), "array<bigint>")

    def passes(key: Column) -> Column:
        first, second = _bits(key, words)
        return (F.getbit(F.get(fixed, _word(first)), _place(first)) == 1) & (F.getbit(F.get(fixed, _word(second)), _place(second)) == 1)

    return passes
