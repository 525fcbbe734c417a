"""Operator 3, packing: concatenate and cut.

Pass one encodes each partition in its own order and writes the ids with their place in the partition. The partitions' token totals are
summed up to offsets, so every document knows its first place in the one long row of ids, and pass two cuts that row every
``WINDOW`` ids. Nothing is shuffled: windows inside a partition are whole there, and only the two windows at a partition's edges leave
boundary records that are put together afterwards. All sequences but the last are full.

Edge cases: null or empty text is the end id alone; repeated rows and equal or null doc_ids are packed one by one; an empty table gives
empty tables; a text longer than a window goes on over as many windows as it needs. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, fresh_path, query, raw_text, read
from veilspan.llm.encoding import encoder, vocabulary

TOKENIZER = "byte_bpe_50k.json"
END, WINDOW, PAD = 0, 1024, 0
#: Texts encoded at once, so that a worker holds a bounded number of bytes.
BYTES_AT_ONCE = 2 << 20


@dataclass(frozen=True)
class Packed:
    """Ids per document at ``path``; ``offsets`` is the first place of each partition, one long per task of pass one."""

    path: str
    offsets: dict[int, int]
    total: int
    window: int


def portions(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of rows with about ``BYTES_AT_ONCE`` of text, as Python values."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        held = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + BYTES_AT_ONCE, "right")))
        yield ids[begin:end].to_pylist(), texts[begin:end].to_pylist()
        begin = end


def encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """part, place (ids before the document in its part), doc_id, n_tokens, ids (little-endian, as wide as the vocabulary needs)."""

    def rows(batches: Iterator[pa.RecordBatch]):
        encode, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for keys, texts in portions(batch.column(0), batch.column(1)):
                ids, sizes = encode.encode(texts)
                ends = np.cumsum(sizes)
                whole = np.insert(ids, ends, end)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                data = whole.astype(whole.dtype.newbyteorder("<")).tobytes()
                wide = whole.dtype.itemsize
                yield {
                    "part": [part] * len(keys), "place": (place + ends - sizes).tolist(), "doc_id": keys, "n_tokens": sizes.tolist(),
                    "ids": [data[a * wide : b * wide] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)],
                }
                place += int(ends[-1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    return arrow_stage(texts, rows, "part int, place long, doc_id long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW) -> Packed:
    """Pass one. What is written to the shared folder fixes the order, so a later loss of executors can't change it."""
    spark = docs.sparkSession
    path = fresh_path(spark, "packing")
    encoded(docs, tokenizer, end).write.option("compression", "zstd").parquet(path)
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each task of pass one
    offsets, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        offsets[r["part"]] = at
        at += r["n"]
    return Packed(path, offsets, at, window)


def _width(binary_length: int, n_tokens: int) -> str:
    return "<u2" if binary_length == 2 * n_tokens else "<u4"


def cuts(start: int, length: int, window: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a document whose first id stands at ``start``, counted from its first id."""
    first = min(length, window - start % window)
    edges = [0, first, *range(first + window, length, window), length]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def pieces(spark: SparkSession, packed: Packed, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids (32 bits each) if asked for."""
    offsets, window = packed.offsets, packed.window

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out: list[tuple] = []
            for part, place, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = offsets[part] + place
                wide = np.frombuffer(raw, _width(len(raw), n)).astype("<u4").tobytes()
                for a, b in cuts(begin, n, window):
                    piece = wide[4 * a : 4 * b]
                    out.append((doc, a, b - a, zlib.crc32(piece), n, (begin + a) // window, (begin + a) % window) + ((piece,) if ids else ()))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=False)) if out else {n: [] for n in names[: 7 + ids]}

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids
    return arrow_stage(spark.read.parquet(packed.path).select("part", "place", "doc_id", "n_tokens", "ids"), rows, schema)


def sequences(spark: SparkSession, packed: Packed) -> DataFrame:
    """sequence_id, n_tokens (without padding), ids padded to the window but for lengths that are a power of two, doc_ids.

    A run of documents that one task reads in order makes its windows whole; pieces of a window that another run shares become
    boundary records, a bounded number for each run, and only those are grouped.
    """
    window = packed.window
    schema = "sequence_id long, offset long, ids binary, doc_ids array<long>"

    def local(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[int, bytes, int]] = []
        now, size = -1, 0

        def close():
            return {"sequence_id": [now], "offset": [held[0][0]], "ids": [b"".join(x[1] for x in held)], "doc_ids": [[x[2] for x in held]]}

        for batch in batches:
            for seq, offset, ids, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (seq != now or offset != held[0][0] + size):
                    yield close()
                    held, size = [], 0
                now = seq
                held.append((offset, ids, doc))
                size += len(ids) // 4
        if held:
            yield close()

    runs = arrow_stage(pieces(spark, packed, ids=True).select("sequence_id", "offset", "ids", "doc_id"), local, schema)
    whole = runs.where(F.length("ids") == 4 * window).select("sequence_id", "ids", "doc_ids")
    boundary = (
        runs.where(F.length("ids") < 4 * window).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_ids"))).alias("runs"))
        .select("sequence_id", F.expr("aggregate(runs, cast('' as binary), (a, r) -> concat(a, r.ids))").alias("ids"), F.flatten("runs.doc_ids").alias("doc_ids"))
    )
    n = F.length("ids") / 4
    missing = F.when(F.length("ids") == F.expr(f"cast(4 * power(2, round(log2(length(ids) / 4))) as int)"), 0).otherwise(4 * window - F.length("ids"))
    padding = F.expr("unhex(repeat('00', cast(missing as int)))")
    return whole.unionByName(boundary).withColumn("n_tokens", n.cast("long")).withColumn("missing", missing).select("sequence_id", "n_tokens", F.concat("ids", padding).alias("ids"), "doc_ids")


@query("op3_pack_windows")
def op3_pack_windows(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spark, pack(read(spark, folder, "documents"), vocabulary(spark, TOKENIZER)))
