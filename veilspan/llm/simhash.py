"""Operator 7, SimHash near-duplicates by pivot distance tables.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints that differ in at most
``BITS`` places link, and linked documents form a component.

Equal fingerprints are one row. By the pigeonhole rule two fingerprints within ``BITS`` places agree wholly in at least
``BLOCKS - BITS`` of ``BLOCKS`` blocks of bits, which is to say that their distances to all references of those blocks are equal; so
each choice of that many blocks is one table, keyed by the blocks. Inside a key the table holds the Hamming distances of each
fingerprint to ``PIVOTS`` reference fingerprints. By the triangle inequality no pair whose coordinates differ anywhere by more
than ``BITS`` can link; such pairs are thrown out, and the exact distance verifies the survivors. No link is lost. A key with many
fingerprints is walked breadth first, so that a tight cluster costs one comparison per member and leaves a spanning tree, not all
pairs; a key with more than ``HOT`` fingerprints is dealt out as pairs of slices over several tasks, each of bounded size.

Edge cases: null or empty text has fingerprint zero and links like any other; fewer words than a shingle are one shingle; repeated
rows share a component; null doc_ids take part but never name a component unless nothing else is in it; an empty table gives an
empty table. Other columns are not read, except by ``one_of_each``, which passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import arrow_stage, cut_lineage, query, raw_text, read

WORDS, SEED, BITS = 4, 42, 4
BLOCKS, PIVOTS, HOT = 6, 16, 20_000
#: Groups up to this size are compared pair by pair, larger ones are walked.
SMALL = 16


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """The hashes of the text's word shingles, in their order; none if there is no word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """As an unsigned number; the zero fingerprint if there is no word."""
    return majority(shingles(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    hashes = hashes.astype("<u8", copy=False)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, text_key (a hash of the text, to tell rows of one doc_id apart), fp (the fingerprint's bits as a signed long)."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in batch.column(2).to_pylist()], np.uint64)
            yield {"doc_id": batch.column(0), "text_key": batch.column(1), "fp": found.view(np.int64)}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), raw_text().alias("text"))
    return arrow_stage(texts, rows, "doc_id long, text_key long, fp long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def block_masks(blocks: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def references(count: int = PIVOTS) -> np.ndarray:
    """The pivots: fixed pseudo-random fingerprints, balanced in their bits."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 1) for i in range(count)], np.uint64)


def near(a: np.ndarray, b: np.ndarray, table_a: np.ndarray, table_b: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs (or of the rows against one) link: first by their coordinates, then by the distance itself."""
    left = (np.abs(table_a - table_b) <= bits).all(axis=-1)
    at = np.flatnonzero(left)
    b = np.broadcast_to(b, a.shape)
    left[at] = np.bitwise_count(a[at] ^ b[at]) <= bits
    return left


def walk(fps: np.ndarray, pivots: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning trees of the links among ``fps``: each found fingerprint is met once and never compared again."""
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    rest = np.arange(len(fps))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            linked = near(fps[rest], fps[at], table[rest], table[at], bits)
            if linked.any():
                new = rest[linked]
                yield np.full(len(new), fps[at]), fps[new]
                front += new.tolist()
                rest = rest[~linked]


def linked_in_runs(fps: np.ndarray, begins: np.ndarray, sizes: np.ndarray, pivots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal key, for many runs at once."""
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = (sizes > 1) & (sizes <= SMALL)
    for lag in range(1, int(sizes[small].max()) if small.any() else 0):
        runs = np.flatnonzero(small & (sizes > lag))
        n = sizes[runs] - lag
        i = np.repeat(begins[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, b = fps[i], fps[i + lag]
        good = near(a, b, np.bitwise_count(a[:, None] ^ pivots).astype(np.int8), np.bitwise_count(b[:, None] ^ pivots).astype(np.int8), bits)
        left.append(a[good])
        right.append(b[good])
    for k in np.flatnonzero(sizes > SMALL):
        for a, b in walk(fps[begins[k] : begins[k] + sizes[k]], pivots, bits):
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, bits: int = BITS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """a, b: links that span the components of the column ``fp`` of distinct fingerprints; each may come from several tables."""
    masks = block_masks(blocks)
    tables = [sum(masks[i] for i in some) for some in combinations(range(blocks), blocks - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))
    heavy = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).withColumn("slices", F.ceil(F.col("n") / hot).cast("int")).drop("n")
    dealt = keyed.join(heavy, ["table", "key"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    pairs = F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.least("own", j).cast("long") * F.col("slices") + F.greatest("own", j))
    )
    groups = dealt.select("fp", "table", "key", F.explode(pairs).alias("slice")).repartition("table", "key", "slice").sortWithinPartitions("table", "key", "slice")
    pivots = references()

    def rows(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            now = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            held = now if held is None else np.concatenate([held, now], axis=1)
            cut = len(held[0]) - 1  # the last run may go on in the next batch
            while cut > 0 and (held[1:, cut - 1] == held[1:, -1]).all():
                cut -= 1
            yield from found(held[:, :cut])
            held = held[:, cut:]
        if held is not None:
            yield from found(held)

    def found(part: np.ndarray):
        if part.shape[1]:
            new = np.concatenate([[True], (part[1:, 1:] != part[1:, :-1]).any(axis=0)])
            begins = np.flatnonzero(new)
            a, b = linked_in_runs(part[0].view(np.uint64), begins, np.diff(np.append(begins, part.shape[1])), pivots, bits)
            if len(a):
                yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    return arrow_stage(groups, rows, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component, by alternating large and small stars; only linked nodes are listed."""
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == mark or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.distinct(), "links")


def grouped(docs: DataFrame, width: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, text_key, fp, component_id: the least doc_id that can be reached over links."""
    marked = cut_lineage(fingerprints(docs, width), "fingerprints")
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), bits))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    # a fingerprint that links to nothing names its own component; only the others meet their root's name
    of_fp = labelled.join(named, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = WORDS, bits: int = BITS) -> DataFrame:
    """The document with the least doc_id of each component, with all its columns; of equal rows one stays."""
    return first_rows(docs, grouped(docs, width, bits), "component_id")


def first_rows(docs: DataFrame, marked: DataFrame, group: str) -> DataFrame:
    """Of the rows of ``docs``, known by doc_id and text_key, one for each value of ``group`` in ``marked``."""
    # rows that share their doc_id are told apart by their text
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    kept = marked.groupBy(group).agg(first).select(*row_key(F.col("first.doc_id"), F.col("first.text_key"))).distinct()
    keyed = docs.select("*", *row_key(F.col("doc_id").cast("long"), text_key()))
    return keyed.join(kept, list(ROW_KEY), "left_semi").dropDuplicates(list(ROW_KEY)).select(*docs.columns)


#: Names that no table has, for the columns that join rows back.
ROW_KEY = ("__row_id", "__row_unnamed", "__row_text")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    return [c.alias(n) for c, n in zip((F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text), ROW_KEY, strict=True)]


@query("op7_simhash_pivots")
def op7_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(read(spark, folder, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
