"""Local-minimum fingerprints of byte strings, with a guaranteed match length.

Every run of ``GRAM`` bytes gets a pseudo-random number; of all the runs inside a window of ``size`` bytes the least number is kept.
A stretch of ``size`` equal bytes in two strings holds an equal window, so both keep that window's number: whoever contains
another string of at least ``size`` bytes holds all its fingerprints. About two in ``size - GRAM + 2`` numbers are kept.

The work is vectorised over the bytes of an Arrow batch as they lie there, ``BLOCK`` window starts at a time, so memory does not follow the
length of a text. Null strings and strings shorter than ``size`` have no fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

GRAM = 16
BLOCK = 1 << 19


def gram_numbers(data: np.ndarray) -> np.ndarray:
    """A number for each run of ``GRAM`` bytes, by its first byte."""
    eight = data.astype(np.uint64)
    for width in (1, 2, 4):  # 1, 2, 4, then 8 bytes side by side in one word
        eight = eight[:-width] | eight[width:] << np.uint64(8 * width)
    both = _mixed(eight[:-8]) * np.uint64(0x9E3779B97F4A7C15) + eight[8:]
    return _mixed(both)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_of(numbers: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbours, by doubling."""
    least, held = numbers, 1
    while 2 * held <= wide:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    rest = wide - held
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def fingerprints_of(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of strings and their fingerprints (signed); string ``k`` is ``data[bounds[k] : bounds[k + 1]]``."""
    last = len(data) - size
    for begin in range(0, last + 1, BLOCK):
        end = min(begin + BLOCK, last + 1)  # windows that start in [begin, end)
        least = least_of(gram_numbers(data[begin : end + size - 1]), size - GRAM + 1)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        heads = bounds[np.searchsorted(bounds, begin) : np.searchsorted(bounds, end)] - begin
        new[heads] = True
        at = np.flatnonzero(new)
        of = np.searchsorted(bounds, at + begin, "right") - 1
        inside = at + begin + size <= bounds[of + 1]
        yield of[inside], least[at[inside]].view(np.int64)


def fingerprints(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """``key, h``: the fingerprints of each row's string; equal ones may come more than once."""
    if size < GRAM:
        raise ValueError(f"windows have {GRAM} bytes at least")
    schema = StructType([df.schema[key], StructField("h", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(1)
            bounds = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
            raw = strings.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
            for of, numbers in fingerprints_of(data, bounds - bounds[0], size):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(numbers)], names=[key, "h"])

    return df.select(key, F.col(value).cast(BinaryType())).mapInArrow(rows, schema)
