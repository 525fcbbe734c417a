"""What the operators of this package share: text columns as bytes, fixed word rule, Arrow stages, bounded collects."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import cut_lineage, fresh_path, shared_folder

__all__ = ["QUERIES", "ORACLES", "query", "read", "raw_text", "arrow_stage", "handing_back", "slices", "plain", "cut_lineage", "fresh_path", "shared_folder"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)``, with the same result in SQL where SQL can say it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def raw_text(column: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty. Bytes reach Python as they are, valid UTF-8 or not."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def plain(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes in a column of texts, so that a worker holds few of them as Python values."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        held = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def hand_back() -> None:
    """Give freed memory back to the system: a worker lives on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def handing_back(rows: Callable[[Iterator[pa.RecordBatch]], Iterable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """The same function for ``mapInArrow``, with freed memory given back when its task ends."""

    def stage(batches):
        try:
            yield from rows(batches)
        finally:
            hand_back()

    return stage


def arrow_stage(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields columns as a dict; they become batches of ``schema``."""

    def stage(batches):
        for columns in rows(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(handing_back(stage), schema)
