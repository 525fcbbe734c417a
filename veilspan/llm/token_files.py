"""Operator 2, token-id files: documents compressed one by one with a shared zstandard dictionary.

A file set is a folder with two tables. ``dictionary`` holds the dictionary and its hash. ``blocks`` holds runs of documents in
ascending doc_id order: their ids as little-endian integers, each document a zstandard frame of its own, and an index of (doc_id, ids,
place and size of the frame) with the dictionary hash. A reader that wants one document reads the blocks whose doc_id range
holds it and unpacks that one frame. Spark's commit protocol writes the blocks, so a lost executor leaves no half files, and any store
that Spark reaches will do.

The dictionary is trained on the first ``SAMPLE_IDS`` ids of about ``SAMPLE_DOCS`` documents chosen by a hash of the doc_id; every
document is encoded whole. Documents are dealt to shards by quantiles of doc_id and sorted inside a shard, which streams.

Edge cases: null or empty text is the end id alone; null doc_ids come first; equal doc_ids and repeated rows follow each other, ordered by
content; an empty table gives an empty file set that reads back as no rows; a document larger than a block is a block of its own.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, fresh_path, query, raw_text, read
from veilspan.llm.encoding import encoder, vocabulary
from veilspan.llm.packing import portions

TOKENIZER, END = "word_bpe_49k.json", 1
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 1_000, 2_048, 64 << 10, 3
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 8_192
#: Bytes that the writer gathers before it writes; rows are whole blocks, so its own default would hold a hundred of them.
WRITER = {"compression": "none", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "16", "parquet.page.size.row.check.min": "4"}
#: Documents per shard, about; a shard is sorted by one task, on disk if need be.
SHARD_DOCS = 5_000
MOST_SHARDS = 10_000
ENTRY = "<qqqq"
#: Stands for a null doc_id in the index, where no document has this id.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class FileSet:
    path: str
    digest: str
    #: ids before each shard, one number per shard
    starts: dict[int, int]


def little(ids: np.ndarray) -> bytes:
    return ids.astype(ids.dtype.newbyteorder("<")).tobytes()


def ended(ids: np.ndarray, sizes: np.ndarray, end: int) -> list[bytes]:
    """The bytes of each document's ids, with the end id."""
    ends = np.cumsum(sizes)
    data, wide = little(np.insert(ids, ends, end)), ids.dtype.itemsize
    cuts = [0, *((ends + np.arange(1, len(ends) + 1)) * wide).tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def dictionary(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    """Trained on a bounded sample; plain content where there is too little to train on."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1)

    def rows(batches: Iterator[pa.RecordBatch]):
        encode = encoder(tokenizer)
        for batch in batches:
            for _, texts in portions(batch.column(0), batch.column(0)):
                ids, sizes = encode.encode(texts)
                yield {"sample": [little(np.append(x[:SAMPLE_IDS], x.dtype.type(end))) for x in np.split(ids, np.cumsum(sizes)[:-1])]}

    samples = [bytes(r["sample"]) for r in arrow_stage(docs.where(chosen).select(raw_text().alias("text")), rows, "sample binary").limit(4 * SAMPLE_DOCS).collect()]
    samples.sort()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def loaded(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def packer(data: bytes) -> zstandard.ZstdCompressor:
    shared = loaded(data)
    if shared is None:
        return zstandard.ZstdCompressor(level=LEVEL)
    shared.precompute_compress(level=LEVEL)  # once per task, not once per document
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)


def unpacker(data: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=loaded(data)) if data else zstandard.ZstdDecompressor()


def write(docs: DataFrame, tokenizer: str, end: int = END, path: str | None = None) -> FileSet:
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    data = dictionary(docs, tokenizer, end)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, bytearray(data))], "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shards = min(MOST_SHARDS, max(1, ids.count() // SHARD_DOCS))
    edges = ids.where("doc_id is not null").agg(F.expr(f"percentile_approx(doc_id, array({', '.join(str(k / shards) for k in range(1, shards))}), 100000)").alias("e")).first()["e"] if shards > 1 else []
    edges = np.unique(np.array(edges or [], np.int64))
    sent = spark.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]):
        ids_of, pack = encoder(tokenizer), packer(sent.value)
        for batch in batches:
            for keys, texts in portions(batch.column(0), batch.column(1)):
                got, sizes = ids_of.encode(texts)
                shard = np.searchsorted(edges, np.array([NO_ID if k is None else k for k in keys], np.int64), "right")
                yield {"shard": shard.astype(np.int32), "doc_id": keys, "n_tokens": (sizes + 1).tolist(), "frame": [pack.compress(x) for x in ended(got, sizes, end)]}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    frames = arrow_stage(texts, encode, "shard int, doc_id long, n_tokens long, frame binary")
    ordered = frames.repartition(len(edges) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "n_tokens", "frame")
    arrow_stage(ordered, blocks_of(digest), "shard int, block int, dict_hash string, first_id long, last_id long, start long, n_docs int, n_tokens long, index binary, frames binary").write.options(**WRITER).parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        starts[r["shard"]] = at
        at += r["n"]
    return FileSet(path, digest, starts)


def blocks_of(digest: str):
    """Sorted frames to blocks; ``start`` counts the ids of the shard before the block."""

    def rows(batches: Iterator[pa.RecordBatch]):
        now, block, start, held, size = None, 0, 0, [], 0

        def close():
            index, at = [], 0
            for doc, n, frame in held:
                index.append(struct.pack(ENTRY, NO_ID if doc is None else doc, n, at, len(frame)))
                at += len(frame)
            known = [x[0] for x in held if x[0] is not None]
            return {
                "shard": [now], "block": [block], "dict_hash": [digest], "first_id": [min(known, default=None)], "last_id": [max(known, default=None)], "start": [start],
                "n_docs": [len(held)], "n_tokens": [sum(x[1] for x in held)], "index": [b"".join(index)], "frames": [b"".join(x[2] for x in held)],
            }

        for batch in batches:
            for shard, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (shard != now or size + len(frame) > BLOCK_BYTES or len(held) == BLOCK_DOCS):
                    yield close()
                    start, block = start + sum(x[1] for x in held), block + 1
                    held, size = [], 0
                if shard != now:
                    now, block, start = shard, 0, 0
                held.append((doc, n, frame))
                size += len(frame)
        if held:
            yield close()

    return rows


def dictionary_of(spark: SparkSession, path: str, digest: str) -> bytes:
    data = bytes(spark.read.parquet(f"{path}/dictionary").where(F.col("dict_hash") == digest).first()["dictionary"])
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError("the dictionary does not match its hash")
    return data


def entries(index: bytes) -> Iterator[tuple[int, int, int, int]]:
    return struct.iter_unpack(ENTRY, index)


def scan(spark: SparkSession, files: FileSet, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; and the ids as 32-bit integers if asked for."""
    return _unpacked(spark.read.parquet(f"{files.path}/blocks"), files, ids, None)


def lookup(spark: SparkSession, files: FileSet, doc_ids: list[int]) -> DataFrame:
    """The same for a few documents: blocks are pruned by their doc_id range, other frames stay packed."""
    wanted = sorted(set(doc_ids))
    reach = F.lit(False)
    for k in wanted:
        reach = reach | ((F.col("first_id") <= k) & (F.col("last_id") >= k))
    return _unpacked(spark.read.parquet(f"{files.path}/blocks").where(reach), files, True, set(wanted))


def _unpacked(blocks: DataFrame, files: FileSet, ids: bool, wanted: set[int] | None) -> DataFrame:
    spark = blocks.sparkSession
    data, starts = spark.sparkContext.broadcast(dictionary_of(spark, files.path, files.digest)), files.starts

    def rows(batches: Iterator[pa.RecordBatch]):
        unpack = unpacker(data.value)
        for batch in batches:
            for shard, begin, digest, index, frames in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest != files.digest:
                    raise ValueError("a block was packed with another dictionary")
                at, out = starts[shard] + begin, []
                for doc, n, place, size in entries(index):
                    if wanted is None or doc in wanted:
                        raw = unpack.decompress(frames[place : place + size])
                        wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                        out.append((None if doc == NO_ID else doc, at, n, zlib.crc32(wide)) + ((wide,) if ids else ()))
                    at += n
                names = ("doc_id", "start", "n_tokens", "ids_crc32", "ids")
                if out:
                    yield dict(zip(names, map(list, zip(*out, strict=True)), strict=False))

    return arrow_stage(blocks.select("shard", "start", "dict_hash", "index", "frames"), rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


@query("op2_token_files")
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, write(read(spark, folder, "documents"), vocabulary(spark, TOKENIZER)))
